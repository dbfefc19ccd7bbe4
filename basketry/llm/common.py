"""Texts as Arrow buffers: slicing into bounded pieces, words and their 64-bit hashes, and stored intermediate tables.

Everything here works on whole texts. A slice holds as many texts as fit into ``limit`` bytes, and at least one, so memory
follows the limit or the longest single text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.runtime import scratch_path

SLICE_BYTES = 1 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Bytes of [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# All but ASCII letters and digits and what lies beyond ASCII.
NO_LETTER = np.ones(256, bool)
NO_LETTER[48:58] = NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep the Arrow batches that go to Python workers small; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and go on from the files: one evaluation, and no lineage to lose."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows with at most ``limit`` bytes of text; null texts are empty."""
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_string()).cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    rows = len(values)
    if not rows:
        return
    _, raw_offsets, raw = values.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[values.offset : values.offset + rows + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words, which are runs of bytes outside ``gap`` within one text."""
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gap[data]
    first = np.ones(size, bool)
    first[1:] = ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < size]
    first[edges] = True
    last = np.ones(size, bool)
    last[:-1] = ~inside[1:]
    last[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hasher:
    """64-bit hashes of spans of a byte array, each span hashed alike wherever it stands."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def prepare(self, data: np.ndarray) -> None:
        size = len(data) + 1
        if len(self.powers) < size:
            for name, base in (("powers", BASE), ("inverses", BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        sums = np.zeros(size, np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * self.powers[: size - 1], out=sums[1:])
        self.sums = sums

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        return mix(value + (ends - starts).astype(np.uint64) * U64(0xD1B54A32D192ED03))


def crc32_remainder(column: str, modulus: int):
    """crc32 of a column's text, modulo ``modulus``; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def worker_memory(key: object, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for the life of the Python worker: Spark reuses workers from task to task."""
    memory = sys.modules.setdefault("basketry_worker_memory", ModuleType("basketry_worker_memory")).__dict__
    if key not in memory:
        memory[key] = make()
    return memory[key]


class Remembered:
    """Results by word, in two generations of about ``size`` words: those not asked for during a whole generation go."""

    def __init__(self, size: int = 300_000) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: set, make: Callable[[list], Iterable]) -> dict:
        """Results of at least ``words``; those not remembered are made together."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        new = words.difference(self.young)
        again = [w for w in new if w in self.old]
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        new.difference_update(again)
        if new:
            missing = list(new)
            self.young.update(zip(missing, make(missing)))
        return self.young
