"""Token counts, byte-level BPE, token files and packing against the libraries and plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketry.llm import byte_bpe, packing, token_counts, token_files, word_ids
from basketry.llm.queries import QUERIES
from basketry.runtime import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
HOSTILE = st.lists(st.sampled_from([*"abtheing ENE\n\t.,!?'-123é漢😀ñ▁\u0301\u00a0\x00<|>", "<|endoftext|>", "<s>"]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def ranked():
    tokens = byte_bpe.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return byte_bpe.ByteBpe(tokens, public_tokenizers.PATTERN), encoding


def unit_ids(encoder, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, bounds = encoder.encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@pytest.fixture(scope="module")
def counter():
    return token_counts._counter(open(PIECES, "rb").read())


@settings(max_examples=60, deadline=None)
@given(st.lists(HOSTILE, max_size=5))
def test_counts_equal_the_library(counter, pieces, texts):
    assert counter(texts) == [len(x) for x in pieces.encode(texts, num_threads=1)]


@pytest.mark.parametrize("text", ["a" * 5000, "the" * 1500, " " * 4000, "ab" * 3000])
def test_counts_of_texts_without_a_break(counter, pieces, text):
    assert counter([text]) == [len(pieces.encode(text))]


@settings(max_examples=100, deadline=None)
@given(HOSTILE)
def test_byte_bpe_equals_the_library(ranked, text):
    bpe, encoding = ranked
    (packed,) = bpe.encode([text])
    assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text)
    assert bpe.decode(packed) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(HOSTILE, max_size=5))
def test_units_equal_the_library(words, texts):
    encoder = word_ids.word_ids(open(WORDS, encoding="utf-8").read())
    assert unit_ids(encoder, texts) == [words.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_when_the_table_starts_anew(words, monkeypatch):
    monkeypatch.setattr(word_ids, "POOL", 40)
    monkeypatch.setattr(word_ids, "SLOTS", 8)
    encoder = word_ids.WordIds(open(WORDS, encoding="utf-8").read())
    texts = [f"word{n} and {n} more, again word{n % 5}" for n in range(60)]
    for n in range(0, 60, 3):
        assert unit_ids(encoder, texts[n : n + 3]) == [words.encode(t, add_special_tokens=False).ids for t in texts[n : n + 3]]


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.mark.parametrize("source", ["awkward", "empty"])
def test_operators_on_awkward_tables(spark, source, request, pieces, ranked, words):
    df = request.getfixturevalue(source)
    docs = texts_of(df)
    got = Counter(tuple(r) for r in token_counts.token_counts(df, PIECES, 4096).collect())
    assert got == Counter((i, len(t.encode()), n := len(pieces.encode(t)), n > 4096) for i, t in docs)
    got = Counter(tuple(r) for r in byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect())
    ids = lambda t: np.array(ranked[1].encode_ordinary(t), "<u4")
    assert got == Counter((i, len(ids(t)), hashlib.sha256(ids(t).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    encoded = byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_documents(encoded, RANKS)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in decoded.collect()) == Counter((i, t.encode()) for i, t in docs)
    path = scratch_path(spark, "test-token-files")
    token_files.write_documents(df, WORDS, 2, path)
    rows = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = [(i, words.encode(t, add_special_tokens=False).ids + [2]) for i, t in docs]
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in rows) == Counter((i, len(x), np.array(x, "<u4").tobytes()) for i, x in want)
    at = 0
    for row in rows:
        assert row.start == at and row.ids_crc32 == zlib.crc32(bytes(row.ids))
        at += row.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    packed = packing.pack_documents(df, WORDS, 0, 2048).collect()
    check_packing(packed, [(i, words.encode(t, add_special_tokens=False).ids + [0]) for i, t in docs], 2048)


def check_packing(rows, docs, capacity):
    want = Counter()
    for i, ids in docs:
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 50, 400):
        totals = np.array([rng.randint(1, 10**rng.randint(1, 9)) for _ in range(n)])
        bits = token_files.code_lengths(totals, 60)
        assert n == 1 or sum(2.0**-b for b in bits) == 1
        heap, cost = sorted(totals.tolist()), 0
        while len(heap) > 1:
            a, b = heap.pop(0), heap.pop(0)
            cost += a + b
            heap = sorted([*heap, a + b])
        assert n == 1 or int((bits * totals).sum()) == cost
        assert token_files.code_lengths(totals, 10).max() <= 10
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, np.int64), 3)


def test_blocks_decode_alone_and_together():
    rng = np.random.default_rng(2)
    tokens = np.sort(rng.choice(60_000, 3000, replace=False))
    bits = token_files.code_lengths(rng.integers(1, 10**6, 3000) ** 2, token_files.LONGEST_CODE)
    code_of, bits_of = token_files.canonical_codes(tokens, bits)
    decoder = token_files.Decoder(tokens, bits)
    blocks = [rng.choice(tokens, n) for n in (1, 127, 128, 129, 5000)]
    payloads = [token_files.encode_block(b, code_of, bits_of) for b in blocks]
    for a, b, p in zip(decoder.decode(payloads), blocks, payloads):
        assert (a == b).all() and (decoder.decode([p])[0] == b).all()


def fewest(lengths, capacity):
    best = [len(lengths)]

    def place(n, rooms):
        if len(rooms) >= best[0]:
            return
        if n == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[n] and rooms[k] not in rooms[:k]:
                place(n + 1, rooms[:k] + [rooms[k] - lengths[n]] + rooms[k + 1 :])
        place(n + 1, rooms + [capacity - lengths[n]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 24).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
def test_bounds_never_exceed_the_optimum(case):
    capacity, lengths = case
    used = packing.best_fit_decreasing(np.array(lengths), capacity)[2]
    assert packing.lower_bound(np.array(lengths), capacity) <= fewest(sorted(lengths, reverse=True), capacity) <= used


def test_exchange_saves_sequences(spark):
    """Partitions of few pieces leave gaps; exchanging closes them."""
    rng = random.Random(3)
    rows = [(n, 0, 0, rng.randint(120, 420), 0) for n in range(600)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    alone = packing.pack(items, 1000, rounds=0, partition_pieces=15).select("sequence_id").distinct().count()
    exchanged = packing.pack(items, 1000, rounds=4, partition_pieces=15)
    assert exchanged.count() == 600
    assert exchanged.select("sequence_id").distinct().count() < alone


@pytest.mark.parametrize("key", ["op3_token_counts", "op5_byte_bpe", "op6_best_fit_packing", "op8_token_files"])
def test_queries_cover_the_whole_table(spark, sf, key, words, pieces, ranked):
    rows = QUERIES[key](spark, sf).collect()
    docs = texts_of(spark.read.parquet(f"{sf}/documents.parquet"))
    if key == "op3_token_counts":
        assert {(r.doc_id, r.n_tokens) for r in rows} == {(i, len(pieces.encode(t))) for i, t in docs}
    elif key == "op5_byte_bpe":
        assert {(r.doc_id, r.ids_sha256) for r in rows} == {(i, hashlib.sha256(np.array(ranked[1].encode_ordinary(t), "<u4").tobytes()).hexdigest()) for i, t in docs}
    elif key == "op6_best_fit_packing":
        used = check_packing(rows, [(i, words.encode(t, add_special_tokens=False).ids + [0]) for i, t in docs], 2048)
        assert used <= -(-sum(r.length for r in rows) // 2048) * 1.02
    else:
        at = 0
        for i, t in sorted(docs):
            ids = words.encode(t, add_special_tokens=False).ids + [2]
            row = next(r for r in rows if r.doc_id == i)
            assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
