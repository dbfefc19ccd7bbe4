"""Token ids as canonical, length-limited Huffman codes in files of independent blocks.

A folder holds two tables. ``codes`` has one row (token, bits) for each token that occurs; the lengths come from the counts of
the whole input by package-merge and fix the codes, which are numbered by length and token. ``blocks`` has one row for each
block: the place of its partition in the order of ids, the tokens before it in that partition, its documents' ids and numbers
of tokens, and its payload. A payload begins with a magic word, the number of tokens and the number of checkpoints; then come
the bit offsets at every ``STRIDE``-th token and the bits, the highest first. A document is never split between blocks.

A reader needs the codes and any one block. It decodes all strides of many blocks at once: one table lookup for each token
gives symbol and length, and the checkpoints say where every stride begins.

Defined results: a null or empty text is the end token alone; null ids come first; rows of equal id come in the order of
their ids' number and content; repeated rows are written once each; an empty table gives empty tables.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm.common import slices, stored
from basketry.llm.word_ids import word_ids

MAGIC = b"TOK1"
STRIDE = 128
BLOCK_TOKENS = 16_384
LONGEST_CODE = 18
# Blocks that are decoded together.
TOGETHER = 48


def token_ids(df: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids binary): ids of every whole text, with the end token, as little-endian unsigned integers.

    They have 16 bits if the vocabulary allows it, else 32.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = file.read()
    kind = "<u2" if max(end_id, Tokenizer.from_str(vocabulary).get_vocab_size() - 1) < 1 << 16 else "<u4"
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        for batch in batches:
            for first, last, data, offsets in slices(batch):
                ids, bounds = words.encode(data, offsets)
                ids = ids.astype(kind)
                packed = [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(bounds) + 1), pa.array(packed, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    key = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_tokens long, ids binary")


def unpacked(size: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // size}") if size else np.zeros(0, "<u4")


def token_totals(ids: DataFrame) -> DataFrame:
    """(token, total) over all documents; a task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for size, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.bincount(unpacked(size, packed.as_py()))
                if len(more) > len(counts):
                    counts, more = more, counts
                counts[: len(more)] += more
        token = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(counts[token], pa.int64())], ["token", "total"])

    return ids.select("n_tokens", "ids").mapInArrow(run, "token long, total long").groupBy("token").agg(F.sum("total").alias("total"))


def code_lengths(totals: np.ndarray, longest: int) -> np.ndarray:
    """Bits for each symbol, at most ``longest``, with the least total by package-merge."""
    n = len(totals)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes of more than {longest} bits")
    order = np.argsort(totals, kind="stable")
    leaves = totals[order].astype(np.int64)
    levels, row = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(longest - 1):
        levels.append(is_leaf)
        whole = len(row) // 2 * 2
        packages = row[0:whole:2] + row[1:whole:2]
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        row, is_leaf = both[by_weight], by_weight < n
    levels.append(is_leaf)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        bits[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.zeros(n, np.int64)
    out[order] = bits
    return out


def canonical_codes(tokens: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by token; tokens that do not occur have length 0."""
    size = int(tokens.max(initial=-1)) + 1
    code_of, bits_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    order = np.lexsort((tokens, bits))
    # In units of the longest code, each code begins where the one before it ends.
    widths = np.int64(1) << (LONGEST_CODE - bits[order])
    code_of[tokens[order]] = ((np.cumsum(widths) - widths) >> (LONGEST_CODE - bits[order])).astype(np.uint64)
    bits_of[tokens] = bits
    return code_of, bits_of


def encode_block(ids: np.ndarray, code_of: np.ndarray, bits_of: np.ndarray) -> bytes:
    bits = bits_of[ids]
    starts = np.cumsum(bits) - bits
    total = int(bits.sum())
    word = starts >> 5
    placed = code_of[ids] << (np.uint64(64) - (bits + (starts & 31)).astype(np.uint64))
    size = (total >> 5) + 3
    # Codes share no bit, so sums are unions; each word stays under 2**32, which floats hold exactly.
    high = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), size)
    low = np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    checkpoints = starts[::STRIDE].astype("<u4")
    return MAGIC + struct.pack("<II", len(ids), len(checkpoints)) + checkpoints.tobytes() + (high + low).astype(np.uint64).astype(">u4").tobytes()


class Decoder:
    def __init__(self, tokens: np.ndarray, bits: np.ndarray) -> None:
        order = np.lexsort((tokens, bits))
        widths = np.int64(1) << (LONGEST_CODE - bits[order])
        self.symbols = np.zeros(1 << LONGEST_CODE, np.uint32)
        self.bits = np.ones(1 << LONGEST_CODE, np.int64)
        filled = int(widths.sum())
        self.symbols[:filled] = np.repeat(tokens[order], widths)
        self.bits[:filled] = np.repeat(bits[order], widths)

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        bodies, begins, counts, sizes, at = [], [], [], [], 0
        for payload in payloads:
            if payload[:4] != MAGIC:
                raise ValueError("not a block of tokens")
            size, lanes = struct.unpack_from("<II", payload, 4)
            body = payload[12 + 4 * lanes :]
            begins.append(np.frombuffer(payload, "<u4", lanes, 12).astype(np.int64) + 8 * at)
            counts.append(np.minimum(STRIDE, size - STRIDE * np.arange(lanes)))
            bodies.append(body)
            sizes.append(size)
            at += len(body)
        data = np.frombuffer(b"".join(bodies) + bytes(4), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        place, count = np.concatenate(begins), np.concatenate(counts)
        target = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for step in range(STRIDE):
            if step and (count <= step).any():
                more = count > step
                place, target, count = place[more], target[more], count[more]
            index = (window[place >> 3] >> (32 - LONGEST_CODE - (place & 7)).astype(np.uint32)) & np.uint32((1 << LONGEST_CODE) - 1)
            out[target + step] = self.symbols[index]
            place = place + self.bits[index]
        return np.split(out, np.cumsum(sizes)[:-1])


def write_token_files(ids: DataFrame, path: str) -> None:
    """Write (doc_id, n_tokens, ids), which must be stored, into a new folder ``path`` in ascending order of doc_id."""
    spark = ids.sparkSession
    # One row for each token of the vocabulary at most.
    totals = token_totals(ids).orderBy("token").toPandas()
    tokens = totals["token"].to_numpy(np.int64)
    bits = code_lengths(totals["total"].to_numpy(np.int64), LONGEST_CODE)
    codes = spark.createDataFrame([(int(t), int(b)) for t, b in zip(tokens, bits)], "token long, bits int")
    codes.coalesce(1).write.parquet(f"{path}/codes")
    code_of, bits_of = canonical_codes(tokens, bits)
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, block, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            payload = encode_block(np.concatenate(parts), code_of, bits_of)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([partition], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()),
                    pa.array([docs], pa.list_(doc_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                ],
                ["partition", "block", "tokens_before", "doc_ids", "sizes", "payload"],
            )

        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, size, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs.append(doc)
                sizes.append(size)
                parts.append(unpacked(size, packed.as_py()))
                held += size
                if held >= BLOCK_TOKENS:
                    yield flush()
                    before, block, held = before + held, block + 1, 0
                    docs, sizes, parts = [], [], []
        if docs:
            yield flush()

    # The last keys only divide the rows of one doc_id, should they be many.
    keys = ["doc_id", "n_tokens", "_content", "_any"]
    ordered = ids.withColumns({"_content": F.xxhash64("ids"), "_any": F.rand(3)}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = ordered.select("doc_id", "n_tokens", "ids")
    schema = f"partition int, block long, tokens_before long, doc_ids array<{kind}>, sizes array<long>, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the folder; ``start`` counts the ids before it."""
    blocks, codes = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/codes").toPandas()
    tokens, bits = codes["token"].to_numpy(np.int64), codes["bits"].to_numpy(np.int64)
    # One row for each partition that was written.
    sizes = blocks.groupBy("partition").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("tokens"))
    written = sizes.orderBy("partition").toPandas()
    before = dict(zip(written["partition"].tolist(), (written["tokens"].cumsum() - written["tokens"]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokens, bits)
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                some = batch.slice(first, TOGETHER)
                decoded = decoder.decode(some.column(4).to_pylist())
                begins = [before[p] + b for p, b in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                counts = some.column(3).to_pylist()
                starts, lengths, crcs, ids = [], [], [], []
                for begin, sizes, block in zip(begins, counts, decoded):
                    at = 0
                    for size in sizes:
                        own = block[at : at + size].astype("<u4").tobytes()
                        starts.append(begin + at)
                        lengths.append(size)
                        crcs.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                        at += size
                columns = [some.column(2).flatten(), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.select("partition", "tokens_before", "doc_ids", "sizes", "payload").mapInArrow(run, schema)


def write_documents(df: DataFrame, tokenizer_file: str, end_id: int, path: str) -> None:
    """Tokenise whole documents and write them to ``path``."""
    write_token_files(stored(token_ids(df, tokenizer_file, end_id), "token-ids"), path)
