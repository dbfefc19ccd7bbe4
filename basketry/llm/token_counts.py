"""Counts of SentencePiece BPE tokens by rank-synchronous merging of arrays.

The distinct pre-tokens of a slice of texts are held as matrices of symbol numbers, one per length. In every round each row
merges its pair of lowest rank, the leftmost on ties, and all rows of a matrix do so at once: a row loses one symbol, so
the matrix stays rectangular. A row leaves when no pair of it is in the table; its surviving symbols are counted.

Pre-tokens are cut where no merge can ever cross: between two characters that stand side by side in no piece. This is exact
for every vocabulary. Normalisation is the library's own. Pre-tokens beyond ``LONGEST`` symbols, such as a text without a
space, go through the same merges with a heap, in n log n steps.

Defined results: a null or empty text has no tokens; rows are counted one by one, so repeated rows repeat their counts; an
empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from basketry.llm.common import Remembered, slices, texts_of, worker_memory

LONGEST = 1024
NO_RANK = np.int32(2**31 - 1)


class MergeTable:
    """Symbols, ranks of adjacent pairs and token costs of one vocabulary."""

    def __init__(self, processor: sentencepiece.SentencePieceProcessor) -> None:
        size = processor.get_piece_size()
        special = lambda i: processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)
        if any(processor.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        pieces = {processor.id_to_piece(i): i for i in range(size) if not special(i)}
        chars = sorted({c for piece in pieces for c in piece})
        symbols = {c: n for n, c in enumerate(chars)}
        for piece in pieces:
            symbols.setdefault(piece, len(symbols))
        # Scores fall as ranks rise; equal scores share a rank, and then the leftmost pair goes first.
        order = {score: n for n, score in enumerate(sorted({processor.get_score(i) for i in pieces.values()}, reverse=True))}
        pairs = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (order[processor.get_score(i)], symbols[piece])
        # Four further symbols stand for characters in no piece, by their UTF-8 length; each of their bytes is a token.
        self.width = len(symbols) + 4
        fallback = processor.is_byte(processor.piece_to_id("<0x00>"))
        self.costs = np.array(
            [1 if s in pieces or not fallback else len(s.encode()) for s in symbols] + [n if fallback else 1 for n in (1, 2, 3, 4)], np.int64
        )
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        by_key = np.argsort(keys)
        self.keys = keys[by_key]
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)[by_key]
        self.ranks, self.merged = values[:, 0].copy(), values[:, 1].copy()
        self.char_codes = np.array([ord(c) for c in chars], np.int64)
        inside = {(ord(a), ord(b)) for piece in pieces for a, b in zip(piece, piece[1:])}
        self.joins = np.array(sorted((a << 21) | b for a, b in inside), np.int64)
        self.line_end_is_apart = not any(10 in pair for pair in inside)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs of symbols; NO_RANK where they never merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NO_RANK), np.where(found, self.merged[at], -1)

    def symbols_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        utf8 = (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        return np.where(self.char_codes[at] == codes, at, self.width - 4 + utf8).astype(np.int32)

    def joined(self, codes: np.ndarray) -> np.ndarray:
        """Whether a merge may cross from each character to the next."""
        key = (codes[:-1] << 21) | codes[1:]
        at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
        return self.joins[at] == key


def count_tokens(table: MergeTable, words: list[str]) -> np.ndarray:
    """Tokens of each pre-token."""
    totals = np.zeros(len(words), np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(codes):
        return totals
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owners = np.repeat(np.arange(len(words)), lengths)
    cut = np.ones(len(codes), bool)
    cut[1:] = (owners[1:] != owners[:-1]) | ~table.joined(codes)
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(codes)))
    symbols = table.symbols_of(codes)
    single = starts[sizes == 1]
    np.add.at(totals, owners[single], table.costs[symbols[single]])
    for size in np.unique(sizes[sizes > 1]):
        rows = starts[sizes == size]
        matrix = symbols[rows[:, None] + np.arange(size)]
        if size > LONGEST:
            counts = np.array([_merge_long(table, row) for row in matrix])
        else:
            counts = _merge_rounds(table, matrix)
        np.add.at(totals, owners[rows], counts)
    return totals


def _merge_rounds(table: MergeTable, matrix: np.ndarray) -> np.ndarray:
    counts = np.zeros(len(matrix), np.int64)
    index = np.arange(len(matrix))
    rank, merged = table.lookup(matrix[:, :-1], matrix[:, 1:])
    while True:
        best = rank.argmin(axis=1)
        rows = np.arange(len(matrix))
        alive = rank[rows, best] != NO_RANK
        if not alive.all():
            counts[index[~alive]] = table.costs[matrix[~alive]].sum(axis=1)
            matrix, rank, merged, index, best = matrix[alive], rank[alive], merged[alive], index[alive], best[alive]
            rows = np.arange(len(matrix))
        if not len(matrix):
            return counts
        matrix[rows, best] = merged[rows, best]
        keep = np.ones(matrix.shape, bool)
        keep[rows, best + 1] = False
        matrix = matrix[keep].reshape(len(rows), -1)
        if matrix.shape[1] == 1:
            counts[index] = table.costs[matrix[:, 0]]
            return counts
        keep = np.ones(rank.shape, bool)
        keep[rows, best] = False
        rank, merged = rank[keep].reshape(len(rows), -1), merged[keep].reshape(len(rows), -1)
        for at in (best - 1, best):
            near = np.flatnonzero((at >= 0) & (at < rank.shape[1]))
            spot = at[near]
            rank[near, spot], merged[near, spot] = table.lookup(matrix[near, spot], matrix[near, spot + 1])


def _merge_long(table: MergeTable, symbols: np.ndarray) -> int:
    """The same merges for one very long pre-token, with a heap over a linked list."""
    rank, merged = table.lookup(symbols[:-1], symbols[1:])
    known: dict[tuple[int, int], tuple[int, int]] = {}
    row, size = symbols.tolist(), len(symbols)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(r, i, row[i], row[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), merged.tolist())) if m >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, result = heapq.heappop(heap)
        j = after[i]
        if row[i] != left or j >= size or row[j] != right:
            continue
        row[i], row[j] = result, -1
        after[i] = after[j]
        if after[i] < size:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < size:
                pair = row[a], row[b]
                if pair not in known:
                    r, m = table.lookup(np.array([pair[0]]), np.array([pair[1]]))
                    known[pair] = int(r[0]), int(m[0])
                r, m = known[pair]
                if m >= 0:
                    heapq.heappush(heap, (r, a, *pair, m))
    return int(table.costs[[s for s in row if s >= 0]].sum())


PRE_TOKEN = re.compile("▁*[^▁]+|▁+")


def _counter(model: bytes):
    """A function from a list of texts to their numbers of tokens."""
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    table = MergeTable(processor)
    # Before a run of these marks no merge can start, unless a piece holds one behind another character.
    mark_starts = not ((table.joins & ((1 << 21) - 1) == 0x2581) & (table.joins >> 21 != 0x2581)).any()
    remembered = Remembered()

    def parts(text: str) -> list[str]:
        text = processor.normalize(text)
        out = PRE_TOKEN.findall(text) if mark_starts else [text]
        if table.line_end_is_apart and "\n" in text:
            out = [x for part in out for x in (re.split("(\n)", part) if "\n" in part else (part,)) if x]
        return out

    def count(texts: list[str]) -> list[int]:
        split = [parts(text) for text in texts]
        known = remembered.of(set().union(*split), lambda words: count_tokens(table, words).tolist())
        return [sum(map(known.__getitem__, words)) for words in split]

    return count


def token_counts(df: DataFrame, model_file: str, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, as the library counts without begin or end tokens.

    The vocabulary file is read by the driver and travels with the tasks.
    """
    with open(model_file, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_memory(("token counts", hash(model)), lambda: _counter(model))
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                tokens = np.array(count([t.decode() for t in texts_of(data, offsets)]), np.int64)
                ids = batch.column(0).slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"]
                )

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column].alias("id"), df[text].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
