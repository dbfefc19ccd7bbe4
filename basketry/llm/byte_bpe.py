"""Byte-level BPE by longest matches and backtracking, in time linear in a word's length.

A word's bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over all tokens finds the longest token
at each place. The encoding that the merges would reach is the only one in which every two adjacent tokens are compatible:
merging the pair's bytes alone gives the same two tokens. So the encoder takes the longest token that is compatible with
the one before it, tries that token's own prefixes next, and steps back when none is left; a place that has failed once is
never tried again. Compatibility of a pair is worked out from the merges once and remembered.

Defined results: a null or empty text has no ids and decodes to no bytes; words that are tokens as a whole are one id;
rows are encoded one by one, so repeated rows repeat their results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from basketry.llm.common import Remembered, slices, texts_of, worker_memory

# Pairs of tokens whose compatibility a worker remembers; the memory starts anew beyond that.
REMEMBERED_PAIRS = 1_000_000
NONE = -1


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 and rank."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, … without gaps")
    return tokens


class ByteBpe:
    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.lengths = [len(t) for t in tokens]
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.shorter = [self._longest_prefix(t) for t in tokens]
        self.known = Remembered()
        self.pairs: dict[tuple[int, int], bool] = {}
        # The last merge of each token, and the token that a pair merges into.
        self.halves: list[tuple[int, int]] = []
        self.merges: dict[tuple[int, int], int] = {}
        for i, token in enumerate(tokens):
            self.halves.append(self._last_merge(i, token))
        # Tokens that no merge makes are ids of whole words only, so they stay out of the search inside words.
        made = [i for i in range(len(tokens)) if self._made(i)]
        self.automaton = ahocorasick.Automaton()
        for i in made:
            self.automaton.add_word(tokens[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        for i in range(len(tokens)):
            while self.shorter[i] != NONE and not self._made(self.shorter[i]):
                self.shorter[i] = self.shorter[self.shorter[i]]

    def _made(self, i: int) -> bool:
        return self.lengths[i] == 1 or self.halves[i][0] != i

    def _longest_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if token[:end] in self.ids:
                return self.ids[token[:end]]
        return NONE

    def _last_merge(self, i: int, token: bytes) -> tuple[int, int]:
        left = self.shorter[i]
        while left != NONE:
            right = self.ids.get(token[self.lengths[left] :], NONE)
            if right != NONE and left < i and right < i and self._made(left) and self._made(right) and self._stable(left, right):
                self.merges[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _stable(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that make the two tokens.

        Undo the later of the two tokens' last merges again and again: at each stage the two symbols at the border must not
        merge earlier than the merge that has been undone last.
        """
        undone = len(self.tokens) + 1
        while True:
            if self.merges.get((left, right), undone) < undone:
                return False
            if left > right:
                undone, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
                undone, outer = right + 1, self.halves[right][0]
                if outer == right:
                    return True
                right = outer
            else:
                undone, outer = right + 1, self.halves[right][0]
                if outer != right:
                    right = outer
                    continue
                undone, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def compatible(self, left: int, right: int) -> bool:
        answer = self.pairs.get((left, right))
        if answer is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            answer = self.pairs[left, right] = self._stable(left, right)
        return answer

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        size, lengths, shorter, compatible = len(word), self.lengths, self.shorter, self.compatible
        longest = [NONE] * size
        for last, token in self.automaton.iter(word.decode("latin-1")):
            longest[last + 1 - lengths[token]] = token
        open_ends = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            before = out[-1] if out else NONE
            while token != NONE:
                end = at + lengths[token]
                if open_ends[end] and (before == NONE or compatible(before, token)):
                    break
                token = shorter[token]
            if token != NONE:
                out.append(token)
                at = end
                token = longest[at] if at < size else NONE
            elif out:
                open_ends[at] = 0
                token = out.pop()
                at -= lengths[token]
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        known = self.known.of(set().union(*split), lambda words: [array("I", self.encode_word(w.encode())).tobytes() for w in words])
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.tokens.__getitem__, ids))


def byte_bpe(tokens: list[bytes], pattern: str) -> ByteBpe:
    """The worker's own encoder for a vocabulary."""
    return worker_memory(("byte bpe", hash(tuple(tokens)), pattern), lambda: ByteBpe(tokens, pattern))


def encode_documents(df: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids binary): ids of every whole text as little-endian unsigned 32-bit integers."""
    tokens = read_ranks(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokens, pattern)
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                packed = bpe.encode([t.decode() for t in texts_of(data, offsets)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())],
                    ["id", "n_tokens", "ids"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column].alias("id"), df[text].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_column)


def decode_documents(df: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for in place of the ids."""
    tokens = read_ranks(rank_file)
    kept = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            decoded = []
            for packed in column:
                numbers = array("I")
                numbers.frombytes(packed.as_py() or b"")
                decoded.append(b"".join(map(tokens.__getitem__, numbers)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(decoded, pa.binary())], [*kept, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ids)
    return df.mapInArrow(run, f"{fields}, `{out}` binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them.

    Both directions run in one pass, so that neither ids nor decoded texts leave the task.
    """
    tokens = read_ranks(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokens, pattern)
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                packed = bpe.encode([t.decode() for t in texts_of(data, offsets)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column].alias("id"), df["text"])
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
