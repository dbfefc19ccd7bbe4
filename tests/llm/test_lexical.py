"""Ranked search against a plain version over all documents, with tiny blocks too."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from basketry.llm import lexical
from tests.llm.conftest import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ITEM = "item_id long, text string, score long, rank int, doc_id string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    each = [(i, Counter(terms(t))) for i, t in docs]
    each = [(i, c) for i, c in each if c]
    n_docs, n_terms = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for doc, counts in each:
            m = 10 + 90 * sum(counts.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in set(terms(text))
                if counts[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k):
    rows = spark.createDataFrame([(i, t, 1, 2, "d") for i, t in items], ITEM)
    return sorted((tuple(r) for r in lexical.ranked_search(docs, rows, k).collect()), key=str)


@pytest.fixture(params=[False, True], ids=["blocks", "tiny blocks"])
def tiny(request, monkeypatch):
    if request.param:
        for name, value in {"BLOCK_DOCUMENTS": 3, "ITEMS": 2, "FIRST_SHARE": 2, "PAIRS": 5, "TERMS": 3}.items():
            monkeypatch.setattr(lexical, name, value)


def test_equals_plain_version(spark, tiny):
    draw = np.random.default_rng(0)
    words = ["alpha", "Beta", "gamma1", "été", "漢字", "x", "the", "OF"]
    texts = [" ".join(draw.choice(words, draw.integers(1, 60), p=[0.02, 0.08, 0.1, 0.05, 0.05, 0.1, 0.4, 0.2])) for _ in range(120)]
    texts += [None, "", " .,;", "alpha" * 3, texts[0], texts[0], "alpha " * 300 + "beta", "é\x00x ALPHA-beta"]
    docs = [(n, t) for n, t in enumerate(texts)] + [(3, texts[4]), (3, texts[4])]
    frame = documents(spark, texts).unionByName(documents(spark, [texts[4], texts[4]], first=3).limit(0))
    extra = [(3, texts[4], *["e"] * 2, 1, 0.5, 3, "c", "k", 1, "i")] * 2 + [(None, "alpha beta", "e", "e", 1, 0.5, 3, "c", "k", 1, "i")]
    frame = frame.unionByName(spark.createDataFrame(extra, frame.schema))
    docs.append((None, "alpha beta"))
    items = [(1, "Alpha gamma1 the THE the"), (2, "of été"), (2, "漢字 x nothing"), (3, None), (4, "..."), (5, "absent words"), (1, "Alpha gamma1 the THE the"), (None, "beta")]
    for k in (1, 10, 500):
        assert searched(spark, frame, items, k) == plain(docs, [i for i in items if i[1]], k)


def test_awkward_and_empty(spark, awkward, empty):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = [(1, "one two three wort"), (2, "😀 don t s")]
    assert searched(spark, awkward, items, 10) == plain(docs, items, 10)
    assert searched(spark, empty, items, 10) == [] and searched(spark, awkward, [], 10) == [] and searched(spark, awkward, [(1, None)], 10) == []


def test_bounds_hold_and_exclude(sf):
    import pandas as pd
    import pyarrow as pa
    from basketry.llm.common import Hasher

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    batch = pa.RecordBatch.from_pandas(docs[["doc_id", "text"]], preserve_index=False)
    found = [d for d in lexical._documents(batch, Hasher())]
    row_bits = max(lexical._row_bits(d) for d in found)
    block = lexical._block(found, row_bits)
    items = lexical.items_of(pd.read_parquet(f"{sf}/benchmark.parquet").text.tolist())
    lengths = np.array(block["lengths"])
    weights = np.arange(1, len(items.hashes) + 1) * 7 % 900
    search = lexical.Search(items, weights, len(found), int(lengths.sum()), 3, np.zeros(items.size, np.int64))
    m = 10 + (90 * lengths * len(found)) // lengths.sum()
    upper = search.bounds(np.frombuffer(block["slices"], np.uint8).reshape(row_bits, -1), row_bits, len(found), lengths, m)
    exact = np.zeros_like(upper)
    for column, d in enumerate(found):
        counts = dict(zip(d.hashes.tolist(), d.counts.tolist()))
        for item in range(items.size):
            for t in items.terms[items.bounds[item] : items.bounds[item + 1]]:
                tf = counts.get(int(items.hashes[t]), 0)
                exact[item, column] += int(weights[t]) * (10**9 * tf // (1000 * tf + 8 * int(m[column])))
    assert (upper >= exact).all()
    search.block(np.array(block["ids"]), lengths, row_bits, block["slices"], np.frombuffer(block["bounds"], np.int64), np.frombuffer(block["hashes"], np.uint64), np.frombuffer(block["counts"], np.uint32))
    assert search.scored < 0.5 * items.size * len(found)
    assert all(sorted(s.tolist(), reverse=True) == sorted(e[e > 0].tolist(), reverse=True)[:3] for (_, s), e in zip(search.best, exact))
