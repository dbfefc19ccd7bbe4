"""Top-k search and URL filter against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import topk, url_filter
from basketry.llm.queries import QUERIES, RULES

VECTORS = "vec_id long, embedding array<float>, label int, score long, query_id long, rank int, asks int"


def plain_top(rows, k, modulus):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for i, v in {(i, tuple(v)) for i, v in usable if i % modulus == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i)[:k]
        for rank, (score, j) in enumerate(scored, 1):
            want[i, rank, j, -score] += 1
    return want


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rng = random.Random(1)
    rows = [(n, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for n in range(150)]
    rows += [(200 + n, rows[5][1]) for n in range(20)] + [(300, [0.0] * 6), (305, [])]
    rows += [(401, None), (None, [1.0] * 6), (405, [None] + [1.0] * 5), (410, [float("nan")] + [1.0] * 5), (415, [float("inf")] + [1.0] * 5), rows[7], rows[10], (420, [1.0, 2.0])]
    found = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=4).collect()
    assert Counter(tuple(r) for r in found) == plain_top(rows, 4, 5)


def test_top_k_of_vectors_of_mixed_length_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = random.Random(2)
    rows = [(n, [rng.uniform(-1, 1) for _ in range(6)]) for n in range(120)]
    rows += [(200 + n, [rng.uniform(-1, 1) for _ in range(6 + n)]) for n in range(1, 4)] + [(5, [0.5, 0.25]), (5, [0.5, 0.25]), (5, [0.501, 0.251])]
    found = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=4).collect()
    assert Counter(tuple(r) for r in found) == plain_top(rows, 4, 5)


def test_top_k_of_huge_components_and_few_rows(spark):
    rows = [(0, [3e20, 1.0]), (5, [2e20, -1.0]), (7, [-1e20, 3.0])]
    found = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=4).collect()
    assert Counter((r.query_id, r.rank, r.vec_id) for r in found) == Counter([(0, 1, 5), (0, 2, 7), (5, 1, 0), (5, 2, 7)])
    assert topk.exact_top_k(vectors(spark, []), F.col("vec_id") % 5 == 0, k=4).count() == 0
    assert topk.exact_top_k(vectors(spark, rows[:1]), F.col("vec_id") % 5 == 0, k=4).count() == 0


def test_search_stops_before_the_end():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.exponential(size=(2000, 3)) * 256)
    counted = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            counted.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    topk.threshold_top(vectors[:1], np.array([-1]), vectors.view(Counting), np.arange(2000), 5)
    assert sum(counted) < 1000


def test_top_k_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op4_threshold_top_k"](spark, sf).collect()) == plain_top(rows, 5, 50)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def rule(host, path, rules):
    fits = [r for r in rules for name, slash, rest in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith(slash + rest)]
    return max(fits, key=len, default=None)


ODD_URLS = [None, "", "no scheme", "http://", "://x", "HTTP://EXAMPLE.Net/en/a", "http://example.net/EN/", "http://net/", "http://net", "http://anet/x", "http://a.net?x/",
            "ftp://b.org/fr/#a?b", "http://x.org/fr", "http://ÄB.example.com/de/ü?q", "a://b://c.net/", "http://c.net/\nd", "http://" + "a" * 40_000 + ".net/"]


@pytest.mark.parametrize("urls", [ODD_URLS, []])
def test_hosts_and_rules(spark, urls):
    pages = spark.createDataFrame([(n, u, "x", "x", "x") for n, u in enumerate(urls)], "page_id long, url string, host string, rule string, score string")
    rows = url_filter.judged(pages, RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path, RULES))
        assert r.verdict == RULES[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_models_tell_hosts_apart(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good = [f"https://{word('aeioulmnrs')}.good/{word('aeioulmnrs')}" for _ in range(300)]
    bad = [f"https://{word('xqzkvwj0123')}.bad/{word('xqzkvwj0123')}" for _ in range(300)]
    new = [f"https://{word('aeioulmnrs')}.new/{word('aeioulmnrs')}" for _ in range(50)] + [f"https://{word('xqzkvwj0123')}.new/{word('xqzkvwj0123')}" for _ in range(50)]
    pages = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judged(pages, {"good/": "allow", "bad/": "block"}).collect()}
    verdicts = [rows[600 + n].verdict == ("allow" if n < 50 else "block") for n in range(100)]
    assert np.mean(verdicts) > 0.95
    only = url_filter.judged(pages, {"good/": "allow"}).collect()
    assert {r.verdict for r in only} == {"allow"}


def test_chances_add_up():
    rng = np.random.default_rng(1)
    counts = np.zeros(url_filter.CELLS)
    counts[rng.integers(0, url_filter.CELLS, 5000)] += rng.integers(1, 9, 5000)
    chances = np.exp(url_filter.log_chances(counts)).reshape(-1, url_filter.SYMBOLS).sum(axis=1)
    assert np.allclose(chances, 1)


def test_url_query(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op9_url_filter"](spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path, RULES))
        assert r.rule is None or r.verdict == RULES[r.rule]
