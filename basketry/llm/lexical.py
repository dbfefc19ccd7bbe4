"""Ranked lexical search over bit-sliced Bloom signatures: an index of the documents, and exact top lists for a set of items.

The index is a table of blocks. A task gathers documents of like size (number of keys, by powers of two) and writes them as one
block: bit j of a document's signature stands in row j of a bitmap with one column per document. The keys of a document are
(term, level) for every level that the term's frequency reaches; levels begin at 1, 2, 3, 5, 9, 17, ... occurrences. A block also has
each document's id, length and its terms with their frequencies, for exact scores.

A search ands the bitmap rows of an item's term. What is left overestimates where the term stands, and for each level the sum of
the terms' weights over such bitmaps, times what the level can add to a score in a document of this length, is an upper bound of
the document's score. Documents whose bound reaches the k-th best score so far are scored exactly, the most promising ones first.
A task remembers its best k per item, so its later blocks are cut harder; a first round over a drawn share of the blocks gives
every task a k-th best score to begin with. The share has no bearing on the result.

Items are searched in blocks of about ``ITEMS``, one pass over the index for each, so the driver and the tasks hold terms and best lists
of one block of items only. Terms are compared by 64-bit hashes.

Scores: w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 10 + (90 * n * N) div L, and a score is the sum of
w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the item's distinct terms.

Defined results: null and empty texts have no terms, count for nothing and are found by no item; items without terms have no rows;
rows of equal item id and equal text are one item, equal ids with other texts are ranked apart; documents of equal or
null id are separate candidates, null ids come last among equal scores; empty tables give no rows. Further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.common import LOWER, NO_LETTER, U64, Hasher, mix, slices, stored, word_bounds
from basketry.runtime import scratch_path

# Frequencies at which a level begins, and the largest of each level; what lies beyond is bounded by the document's length.
LEVELS = np.array([1, 2, 3, 5, 9, 17, 33], np.int64)
TOPS = np.array([1, 2, 4, 8, 16, 32], np.int64)
LEVEL_MARKS = mix(np.arange(1, len(LEVELS) + 1, dtype=np.uint64))
BITS_PER_KEY = 8
HASHES = 3
BLOCK_DOCUMENTS = 1024
BLOCK_BYTES = 1 << 20
ITEMS = 512
FIRST_SHARE = 64  # One block in so many is searched first.
PAIRS = 1 << 13  # Documents scored at a time.
BATCH_BLOCKS = 4  # Rows of the index, of up to a few MB each, that are sent to a Python worker at a time.
TERMS = 2048  # Bitmaps of terms summed at a time.

INDEX = "ids array<long>, lengths array<long>, row_bits int, slices binary, bounds binary, hashes binary, counts binary, mark long"


def _positions(hashes: np.ndarray, level: int, row_bits: int) -> np.ndarray:
    """The bitmap rows of (term, level) keys, one line per key."""
    seed = mix(hashes ^ LEVEL_MARKS[level])
    step = (seed >> U64(32)) | U64(1)
    return ((seed[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & U64(row_bits - 1)).astype(np.int64)


@dataclass
class Document:
    id: int | None
    length: int
    hashes: np.ndarray
    counts: np.ndarray


def _block(documents: list[Document], row_bits: int) -> dict:
    sizes = np.array([len(d.hashes) for d in documents], np.int64)
    hashes = np.concatenate([d.hashes for d in documents])
    counts = np.concatenate([d.counts for d in documents])
    column = np.repeat(np.arange(len(documents)), sizes)
    bitmap = np.zeros((row_bits, -(-len(documents) // 8)), np.uint8)
    for level, least in enumerate(LEVELS):
        reached = counts >= least
        if not reached.any():
            break
        rows, at = _positions(hashes[reached], level, row_bits), column[reached]
        for hash_number in range(HASHES):
            np.bitwise_or.at(bitmap, (rows[:, hash_number], at >> 3), (128 >> (at & 7)).astype(np.uint8))
    bounds = np.append(0, np.cumsum(sizes))
    return {
        "ids": [d.id for d in documents],
        "lengths": [d.length for d in documents],
        "row_bits": row_bits,
        "slices": bitmap.tobytes(),
        "bounds": bounds.tobytes(),
        "hashes": hashes.tobytes(),
        "counts": counts.astype(np.uint32).tobytes(),
        # Drawn, as far as documents go: the same for the same block.
        "mark": int(mix(hashes[:1] ^ U64(len(hashes)))[0].astype(np.int64)),
    }


def _documents(batch: pa.RecordBatch, hasher: Hasher) -> Iterator[Document]:
    """Documents with terms, with their distinct terms and frequencies."""
    ids = batch.column(0).to_pylist()
    for first, end, data, offsets in slices(batch):
        data = LOWER[data]
        starts, ends, owner = word_bounds(data, offsets, NO_LETTER)
        if not len(starts):
            continue
        hasher.prepare(data)
        value = hasher.spans(starts, ends)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(value)))
        value, owner = value[at], owner[at]
        edges = np.searchsorted(owner, np.arange(end - first + 1))
        for n in np.unique(owner):
            mine = slice(edges[n], edges[n + 1])
            # Copies, as a document that waits for its block would keep the whole slice.
            yield Document(ids[first + n], int(counts[mine].sum()), value[mine].copy(), counts[mine].astype(np.uint32))


def _row_bits(document: Document) -> int:
    keys = int((document.counts[:, None] >= LEVELS).sum())
    return max(64, 1 << (BITS_PER_KEY * keys - 1).bit_length())


def write_index(documents: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of ``documents`` to ``path`` and read it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, waiting = Hasher(), {}
        schema = None

        def flushed(row_bits: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(waiting.pop(row_bits), row_bits)], schema)

        for batch in batches:
            schema = schema or pa.schema(
                [("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("row_bits", pa.int32())]
                + [(name, pa.binary()) for name in ("slices", "bounds", "hashes", "counts")]
                + [("mark", pa.int64())]
            )
            for document in _documents(batch, hasher):
                row_bits = _row_bits(document)
                held = waiting.setdefault(row_bits, [])
                held.append(document)
                if len(held) == BLOCK_DOCUMENTS or len(held) * row_bits >= 8 * BLOCK_BYTES:
                    yield flushed(row_bits)
        for row_bits in sorted(waiting):
            yield flushed(row_bits)

    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(run, INDEX).write.parquet(path)
    return documents.sparkSession.read.schema(INDEX).parquet(path)


@dataclass
class Items:
    """A block of items: their terms as positions in a sorted list of hashes, one item after the other."""

    hashes: np.ndarray
    terms: np.ndarray
    bounds: np.ndarray

    @property
    def size(self) -> int:
        return len(self.bounds) - 1


def items_of(texts: list[str]) -> Items:
    hasher, each = Hasher(), []
    for text in texts:
        data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), NO_LETTER)
        if len(data):
            hasher.prepare(data)
        each.append(np.unique(hasher.spans(starts, ends)) if len(starts) else np.zeros(0, np.uint64))
    hashes, terms = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_inverse=True)
    return Items(hashes, terms.astype(np.int64), np.append(0, np.cumsum([len(e) for e in each])).astype(np.int64))


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _document_counts(index: DataFrame, hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """N, L, and in how many documents each of the sorted ``hashes`` stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, terms, found = 0, 0, np.zeros(len(hashes), np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                lengths = batch.column(0)[n].values.to_numpy()
                documents += len(lengths)
                terms += int(lengths.sum())
                at, hit = _looked_up(_array(batch.column(1)[n], np.uint64), hashes)
                found += np.bincount(at[hit], minlength=len(hashes))
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], term])), pa.array(np.concatenate([[documents, terms], found[term]]))], ["term", "n"]
        )

    rows = index.select("lengths", "hashes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found, totals = np.zeros(len(hashes), np.int64), {-2: 0, -1: 0}
    for r in rows:
        if r["term"] < 0:
            totals[r["term"]] = r["n"]
        else:
            found[r["term"]] = r["n"]
    return totals[-2], totals[-1], found


def _looked_up(values: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
    return at, hashes[at] == values


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


NO_ID = (1 << 63) - 1


class Search:
    """Best ``k`` documents per item among the blocks seen so far."""

    def __init__(self, items: Items, weights: np.ndarray, documents: int, terms: int, k: int, least: np.ndarray) -> None:
        self.items, self.weights, self.documents, self.terms, self.k = items, weights, documents, terms, k
        self.least = least.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(items.size)]
        self.owner = np.repeat(np.arange(items.size), np.diff(items.bounds))
        self.scored = 0

    def bounds(self, bitmap: np.ndarray, row_bits: int, columns: int, lengths: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, items by documents."""
        out = np.zeros((self.items.size, columns), np.int64)
        before, present = np.zeros(columns, np.int64), None
        for level in range(len(LEVELS)):
            rows = np.bitwise_and.reduce(bitmap[_positions(self.items.hashes, level, row_bits)], axis=1)
            # A term that reaches a level reaches those below it.
            present = rows if present is None else rows & present
            if not present.any():
                break
            top = np.minimum(TOPS[level], lengths) if level < len(TOPS) else lengths
            gain = _gain(top, m)
            # Terms without a bit in any document of the block add nothing at this level.
            some = np.flatnonzero(present.any(axis=1)[self.items.terms])
            for at in range(0, len(some), TERMS):
                term, owner = self.items.terms[some[at : at + TERMS]], self.owner[some[at : at + TERMS]]
                bits = np.unpackbits(present[term], axis=1, count=columns)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                weighted = bits * self.weights[term][:, None]
                out[owner[first]] += np.add.reduceat(weighted, first, axis=0) * (gain - before)
            before = gain
        return out

    def block(self, ids: np.ndarray, lengths: np.ndarray, row_bits: int, bitmap: bytes, bounds: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        columns = len(ids)
        if not columns or not self.items.size:
            return
        rows = np.frombuffer(bitmap, np.uint8).reshape(row_bits, -1)
        m = 10 + (90 * lengths * self.documents) // self.terms
        upper = self.bounds(rows, row_bits, columns, lengths, m)
        at, hit = _looked_up(hashes, self.items.hashes)
        document = np.repeat(np.arange(columns), np.diff(bounds))[hit]
        # Sorted, as documents follow one another and their terms are sorted by hash.
        self.keys = document * len(self.items.hashes) + at[hit]
        self.gains = _gain(counts[hit].astype(np.int64), m[document])
        first = min(columns, 2 * self.k)
        promising = np.argpartition(-upper, first - 1, axis=1)[:, :first]
        item = np.repeat(np.arange(self.items.size), first)
        self.take(item, promising.ravel(), upper, ids)
        upper[item, promising.ravel()] = 0
        item, columns_left = np.nonzero(upper >= np.maximum(self.least, 1)[:, None])
        self.take(item, columns_left, upper, ids)

    def take(self, item: np.ndarray, column: np.ndarray, upper: np.ndarray, ids: np.ndarray) -> None:
        """Score (item, document) pairs whose bound reaches the item's k-th best and keep the best; items ascend."""
        keep = upper[item, column] >= np.maximum(self.least[item], 1)
        item, column = item[keep], column[keep]
        for at in range(0, len(item), PAIRS):
            self.merge(item[at : at + PAIRS], column[at : at + PAIRS], ids)

    def merge(self, item: np.ndarray, column: np.ndarray, ids: np.ndarray) -> None:
        self.scored += len(item)
        sizes = np.diff(self.items.bounds)[item]
        pair = np.repeat(np.arange(len(item)), sizes)
        term = self.items.terms[np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.items.bounds[:-1][item], sizes)]
        place, hit = _looked_up(column[pair] * len(self.items.hashes) + term, self.keys)
        scores = np.zeros(len(item), np.int64)
        np.add.at(scores, pair[hit], self.weights[term[hit]] * self.gains[place[hit]])
        good = scores >= np.maximum(self.least[item], 1)
        item, scores, found = item[good], scores[good], ids[column[good]]
        edges = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else []
        for a, b in zip(edges, np.append(edges[1:], len(item))):
            n = item[a]
            old_ids, old = self.best[n]
            every_id, every = np.concatenate([old_ids, found[a:b]]), np.concatenate([old, scores[a:b]])
            top = np.lexsort((every_id, -every))[: self.k]
            self.best[n] = every_id[top], every[top]
            if len(top) == self.k:
                self.least[n] = max(self.least[n], every[top[-1]])


def _tops(index: DataFrame, items: Items, weights: np.ndarray, documents: int, terms: int, k: int, least: np.ndarray) -> DataFrame:
    """(item, id, score): each task's best k per item that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, weights, documents, terms, k, least)
        for batch in batches:
            for n in range(batch.num_rows):
                one = [batch.column(i)[n] for i in range(7)]
                ids = one[0].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                lengths = one[1].values.to_numpy()
                search.block(ids, lengths, one[2].as_py(), one[3].as_buffer(), _array(one[4], np.int64), _array(one[5], np.uint64), _array(one[6], np.uint32))
        for n, (ids, scores) in enumerate(search.best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n)), pa.array(ids), pa.array(scores)], ["item", "id", "score"])

    columns = ("ids", "lengths", "row_bits", "slices", "bounds", "hashes", "counts")
    return index.select(*columns).mapInArrow(run, "item long, id long, score long")


def _ranked(tops: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "id"))
    return tops.withColumn("rank", place).filter(F.col("rank") <= k)


@contextmanager
def small_batches_of_blocks(spark: SparkSession) -> Iterator[None]:
    """Few rows of the index at a time for the jobs that run inside; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def search_block(index: DataFrame, ids: list, texts: list[str], k: int, id_column: str, kind: str) -> DataFrame | None:
    """Top lists of some items; None if no item has a term."""
    spark = index.sparkSession
    items = items_of(texts)
    if not len(items.hashes):
        return None
    with small_batches_of_blocks(spark):
        documents, terms, found = _document_counts(index, items.hashes)
        if not documents:
            return None
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in found], np.int64)
        none = np.zeros(items.size, np.int64)
        drawn = index.filter(F.pmod("mark", F.lit(FIRST_SHARE)) == 0)
        first = _ranked(_tops(drawn, items, weights, documents, terms, k, none), k).filter(F.col("rank") == k).select("item", "score").collect()
        for r in first:
            none[r["item"]] = r["score"]
        tops = stored(_tops(index, items, weights, documents, terms, k, none), "lexical-tops")
    names = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], f"item long, item_id {kind}")
    ranked = _ranked(tops, k)
    found_id = F.when(F.col("id") != NO_ID, F.col("id")).alias(id_column)
    # One row per item of this block.
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", found_id, "score")


def ranked_search(
    documents: DataFrame, items: DataFrame, k: int = 10, path: str | None = None, id_column: str = "doc_id", item_column: str = "item_id"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item. Writes an index and runs jobs over it."""
    spark: SparkSession = documents.sparkSession
    kind = items.schema[item_column].dataType.simpleString()
    wanted = items.select(F.col(item_column).alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0).distinct()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, {id_column} long, score long")
    blocks = -(-wanted.count() // ITEMS)
    if not blocks:
        return out.withColumnRenamed("item_id", item_column)
    index = write_index(documents, path or scratch_path(spark, "lexical-index"), id_column)
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found = search_block(index, [r["item_id"] for r in rows], [r["text"] for r in rows], k, id_column, kind)
        if found is not None:
            out = out.unionByName(found)
    return out.withColumnRenamed("item_id", item_column)
