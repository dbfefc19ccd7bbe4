"""Token ids from the tokenizers library, asked once for each distinct unit of text.

For vocabularies that lower-case and whose pre-tokenizer never joins anything across ASCII white space, nor a letter or digit
with a mark (the caller's choice), a text's ids are the ids of its units in order. Units are cut at white space, and
between ASCII letters or digits and ASCII marks, but for the four marks that may belong with letters: apostrophes of
contractions, and the brackets and bars of special tokens. Units are found and compared as arrays, by 64-bit hashes; those
that a worker has not met are joined by a special token, which the library splits off before anything else, and encoded in
one call. A worker remembers units in a table of fixed size, where a new unit takes the place of another of the same slot.
Letters A-Z are lower-cased beforehand, so that fewer units are distinct, unless the texts have combining marks,
which may join with a letter only before lower-casing, or the beginnings of special tokens, which are told apart by case.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
from tokenizers import Tokenizer

from basketry.llm.common import IS_SPACE, LOWER, U64, Hasher, worker_memory

TOGETHER = 2000
SLOTS = 1 << 21
# Ids that are kept before the table starts anew.
POOL = 16_000_000
LEFT_ALONE = (b"\xcc", b"\xcd", b"<|")
# 0 other, 1 ASCII letter or digit, 2 mark, 3 white space.
KIND = np.zeros(256, np.uint8)
KIND[48:58] = KIND[65:91] = KIND[97:123] = 1
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = 2
KIND[IS_SPACE] = 3
# Whether a unit ends between two kinds.
CUT = np.zeros((4, 4), bool)
CUT[1, 2] = CUT[2, 1] = True
CUT[3, :] = CUT[:, 3] = True
CUT = CUT.ravel()


class WordIds:
    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = Tokenizer.from_str(vocabulary)
        special = [t for t in json.loads(vocabulary)["added_tokens"] if t["special"] and not t["normalized"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark, self.mark_id = (special[0]["content"], special[0]["id"]) if special else (None, None)
        self.hasher = Hasher()
        self.keys, self.begins, self.sizes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.pool, self.used = np.zeros(POOL, self.kind), 0

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[bytes]:
        together = [t for t in texts if self.mark is not None and self.mark not in t]
        by_text: dict[str, list[int]] = {}
        for first in range(0, len(together), TOGETHER):
            some = together[first : first + TOGETHER]
            ids = self._encode(self.mark.join(some))
            ends = [n for n, i in enumerate(ids) if i == self.mark_id] + [len(ids)]
            if len(ends) == len(some):
                by_text.update(zip(some, (ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends))))
        return [array("I", by_text[t] if t in by_text else self._encode(t)).tobytes() for t in texts]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after the other, and where each text's ids begin and end."""
        texts, size = len(offsets) - 1, len(data)
        if not size:
            return np.zeros(0, self.kind), np.zeros(texts + 1, np.int64)
        raw = data.tobytes()
        if not any(x in raw for x in LEFT_ALONE):
            data = LOWER[data]
            raw = data.tobytes()
        kind = KIND[data]
        cut = np.ones(size + 1, bool)
        cut[1:-1] = CUT[kind[:-1] * 4 + kind[1:]]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        inside = kind[starts] != 3
        starts, ends = starts[inside], ends[inside]
        self.hasher.prepare(data)
        begins, each = self._places(self.hasher.spans(starts, ends) | U64(1), starts, ends, raw)
        ends_out = np.cumsum(each, dtype=np.int64)
        ids = self.pool[np.repeat(begins.astype(np.int64) - (ends_out - each), each) + np.arange(int(ends_out[-1]) if len(each) else 0)]
        sums = np.append(0, ends_out)
        return ids, sums[np.searchsorted(starts, offsets)]

    def _places(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each unit's ids begin in the pool, and how many they are; a hash of 0 would mean an empty slot."""
        if self.used > POOL * 3 // 4:
            self.keys[:] = 0
            self.pool, self.used = np.zeros(POOL, self.kind), 0
        slots = (hashes & U64(SLOTS - 1)).astype(np.int64)
        begins, sizes = self.begins[slots], self.sizes[slots]
        missed = np.flatnonzero(self.keys[slots] != hashes)
        if len(missed):
            units, first, place = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[first]
            packed = self._ids([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            new = np.frombuffer(b"".join(packed), "<u4").astype(self.kind)
            new_sizes = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
            new_begins = self.used + np.cumsum(new_sizes) - new_sizes
            if self.used + len(new) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], new])
            self.pool[self.used : self.used + len(new)] = new
            self.used += len(new)
            begins[missed], sizes[missed] = new_begins[place], new_sizes[place]
            slots, one = np.unique((units & U64(SLOTS - 1)).astype(np.int64), return_index=True)
            self.keys[slots], self.begins[slots], self.sizes[slots] = units[one], new_begins[one], new_sizes[one]
        return begins, sizes


def word_ids(vocabulary: str) -> WordIds:
    """The worker's own encoder for a vocabulary."""
    return worker_memory(("word ids", hash(vocabulary)), lambda: WordIds(vocabulary))
