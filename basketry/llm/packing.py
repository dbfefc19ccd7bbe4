"""Best-fit packing of documents into sequences, certified by lower bounds and repaired where the bounds leave a gap.

Pieces are dealt at random into partitions of bounded size and packed there by best-fit decreasing. Dual feasible functions
give each partition a number of sequences that no packing of it can go below. Where the packing needs more, the pieces of
its sequences with room left are exchanged: all such pieces are dealt anew and packed again. A round counts only if it
saves sequences, and the rounds end when no partition has a gap, when a round saves nothing, or after ``rounds``.

Defined results: a null or empty text is the end token alone; repeated rows are packed as separate documents; pieces of
equal length are taken in the order of doc_id, piece and start; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import slices, stored
from basketry.llm.word_ids import word_ids

PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"
PLACED = "sequence int, offset long, fill long, used int, bound int"
# Enough pieces for best-fit decreasing to reach the bound in nearly all partitions, and few for one task.
PARTITION_PIECES = 4_096


def pieces(df: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    """Documents as token ids with ``end_id`` behind each; only those longer than ``capacity`` are cut."""
    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = file.read()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        for batch in batches:
            for first, last, data, offsets in slices(batch):
                rows, piece, start, length, crc = [], [], [], [], []
                ids, bounds = words.encode(data, offsets)
                for row in range(first, last):
                    packed = ids[bounds[row - first] : bounds[row - first + 1]].astype("<u4").tobytes() + end
                    for n, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        rows.append(row)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                owners = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [owners, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return df.select("doc_id", "text").mapInArrow(run, PIECES.format(kind=df.schema["doc_id"].dataType.simpleString()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, taken by falling length, and the number of sequences."""
    sequence, offset = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0  # bit r of the mask: some sequence has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = mask >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, at, used = capacity, used, used + 1
        sequence[i], offset[i] = at, capacity - left
        left -= length
        if left:
            room[left].append(at)
            mask |= 1 << left
    return sequence, offset, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound from two families of dual feasible functions.

    One ignores pieces under a threshold and lets those over ``capacity - threshold`` fill a sequence; the other rounds
    lengths to multiples of capacity/k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    low = np.arange(capacity // 2 + 1)
    below = np.maximum(low - 1, 0)
    high = number[-1] - number[capacity - low]
    middle = number[capacity - low] - number[below]
    weight = total[capacity - low] - total[below]
    # The mass of pieces from the threshold to capacity - threshold, and for those over half of it one sequence each.
    best = int((high + -(-weight // capacity))[1:].max(initial=-(-total[-1] // capacity)))
    large = number[capacity - low] - number[capacity // 2]
    best = max(best, int((high + np.maximum(large, np.where(middle > 0, -(-weight // capacity), 0))).max()))
    sizes = np.arange(capacity + 1)
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, int(-(-(value * count).sum() // (k * capacity))))
    return best


def _packer(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.drop_columns(["bucket"]).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths = group.column("length").to_numpy()
        sequence, offset, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(sequence, weights=lengths, minlength=used).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        more = [pa.array(sequence), pa.array(offset), pa.array(fill[sequence]), pa.array(np.full(len(lengths), used, np.int32)), pa.array(np.full(len(lengths), bound, np.int32))]
        for name, column in zip(("sequence", "offset", "fill", "used", "bound"), more):
            group = group.append_column(name, column)
        return group

    return run


def pack(items: DataFrame, capacity: int, rounds: int = 4, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """``items`` (stored; doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    Runs jobs: each round is written to the shared folder, and two counts decide whether it goes on.
    """
    kind = items.schema["doc_id"].dataType.simpleString()
    schema = f"bucket_no int, {PIECES.format(kind=kind)}, {PLACED}"
    packer = _packer(capacity)

    def with_bucket(key: tuple, group: pa.Table) -> pa.Table:
        out = packer(group)
        return out.add_column(0, "bucket_no", pa.array(np.full(len(out), key[0].as_py(), np.int32)))

    def packed(rows: DataFrame, number: int, turn: int) -> DataFrame:
        buckets = max(1, -(-number // partition_pieces))
        dealt = rows.withColumn("bucket", F.floor(F.rand(turn) * buckets).cast("int"))
        return stored(dealt.groupBy("bucket").applyInArrow(with_bucket, schema).withColumn("turn", F.lit(turn)), "packed")

    open_ones = (F.col("used") > F.col("bound")) & (F.col("fill") < capacity)
    columns = items.columns
    current = packed(items, items.count(), 0)
    finished = []
    for turn in range(1, rounds + 1):
        released = current.filter(open_ones)
        pieces_left, before = released.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if not pieces_left:
            break
        again = packed(released.select(columns), pieces_left, turn)
        after = again.filter("offset = 0").count()
        if after >= before:
            break
        finished.append(current.filter(~open_ones))
        current = again
    whole = reduce(DataFrame.unionByName, [*finished, current])
    # Rounds, buckets and sequences are numbered apart; together they number the sequence.
    number = F.shiftleft(F.col("turn").cast("long"), 56).bitwiseOR(F.shiftleft(F.col("bucket_no").cast("long"), 28)).bitwiseOR(F.col("sequence").cast("long"))
    return whole.select(*columns, number.alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, tokenizer_file: str, end_id: int, capacity: int, rounds: int = 4) -> DataFrame:
    """Pieces of all documents with their place: no sequence holds more than ``capacity`` tokens, offsets have no gaps."""
    return pack(stored(pieces(df, tokenizer_file, end_id, capacity), "pieces"), capacity, rounds)
