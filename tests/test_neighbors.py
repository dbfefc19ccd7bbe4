"""Neighbour search and dense scoring against brute force, with copies and hot dimensions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import blocks, carousel, neighbors, vectors


def brute(x, ids, k):
    unit = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 12)
    sims = np.round(unit @ unit.T, 9)
    out = {}
    for i, user in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and sims[i, j] > 0), key=lambda j: (-sims[i, j], ids[j]))
        out[user] = [(int(ids[j]), float(sims[i, j])) for j in order[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("user_id", "rank").collect():
        out.setdefault(r.user_id, []).append((r.neighbor, r.sim))
    return out


@pytest.fixture(scope="module")
def vectors_with_copies():
    rng = np.random.default_rng(3)
    n, d = 240, 30
    x = np.where(rng.random((n, d)) < 0.12, rng.integers(1, 6, (n, d)), 0).astype(float)
    x[:, 0] = np.where(rng.random(n) < 0.8, rng.integers(1, 4, n), x[:, 0])  # one dimension nearly everybody has
    x[60:140] = 0
    x[60:140, 0] = 2.0  # a third of the users are copies of each other
    x[x.sum(axis=1) == 0, 1] = 1.0
    ids = np.arange(n) * 3 + 1
    rows = [(int(ids[i]), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return x, ids, pd.DataFrame(rows, columns=["user_id", "item_id", "weight"])


@pytest.mark.parametrize("k,block", [(5, 7), (5, 64), (20, 4096)])
def test_user_knn_is_exact(spark, vectors_with_copies, k, block):
    x, ids, rows = vectors_with_copies
    got = collected(neighbors.user_knn(spark.createDataFrame(rows), k, block=block))
    want = brute(x, ids, k)
    for user, expected in want.items():
        assert [n for n, _ in got.get(user, [])] == [n for n, _ in expected], user
        assert np.allclose([s for _, s in got.get(user, [])], [s for _, s in expected])


def test_far_blocks_are_skipped(spark):
    """Users of 20 tastes: a block of one taste is not sent to blocks of others, and nothing is lost."""
    rng = np.random.default_rng(11)
    n, tastes, wide = 400, 20, 8
    x = np.zeros((n, tastes * wide + 1))
    for user in range(n):
        taste = user % tastes
        x[user, taste * wide : (taste + 1) * wide] = rng.integers(1, 9, wide)
        x[user, -1] = 0.5  # Something that everybody has, so that every pair is similar to a degree.
    rows = pd.DataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], columns=["user_id", "item_id", "weight"])
    unit = neighbors.unit_vectors(spark.createDataFrame(rows)).cache()
    dealt = neighbors.dealt_blocks(unit, 20).cache()
    blocks = dealt.select("block").distinct().count()
    sims = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
    least = spark.createDataFrame([(u, float(np.sort(sims[u])[-5])) for u in range(n)], "user_id long, least double")
    looked_at = neighbors.reachable_blocks(dealt, least).count()
    assert blocks == n // 20 and looked_at < 0.35 * n * (blocks - 1)
    got = collected(neighbors.unit_knn(unit, 4, block=20))
    assert all([m for m, _ in got[u]] == [m for m, _ in want] for u, want in brute(x, np.arange(n), 4).items())


def test_profile_knn_is_exact(spark, vectors_with_copies):
    x, ids, rows = vectors_with_copies
    unit = neighbors.unit_vectors(spark.createDataFrame(rows).withColumn("dim", F.concat(F.lit("d"), "item_id")), "dim")
    got = collected(vectors.profile_knn(unit, 6, block=40))
    for user, expected in brute(x, ids, 6).items():
        assert [n for n, _ in got[user]] == [n for n, _ in expected]


@pytest.mark.parametrize("block,tile", [(16, 5), (4096, 512)])
def test_embedding_topn(spark, block, tile):
    rng = np.random.default_rng(5)
    q, i = rng.integers(-3, 4, (50, 6)).astype(float), rng.integers(-3, 4, (70, 6)).astype(float)
    queries = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(q)], "query_id long, vector array<double>")
    items = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(i)], "item_id long, vector array<double>")
    banned = spark.createDataFrame([(n, m) for n in range(0, 50, 2) for m in range(0, 70, 3)], "query_id long, item_id long")
    got = vectors.embedding_topn(queries, items, 8, block, tile, exclude=banned).toPandas()
    scores = q @ i.T
    for n in range(50):
        open_items = [m for m in range(70) if n % 2 or m % 3]
        want = sorted(open_items, key=lambda m: (-scores[n, m], m))[:8]
        assert got[got.query_id == n].sort_values("rank").item_id.tolist() == want


def test_short_items_are_skipped(spark):
    """Items of very uneven length: most queries stop after the block of the longest."""
    rng = np.random.default_rng(12)
    q, i = rng.standard_normal((40, 5)), rng.standard_normal((300, 5)) * np.geomspace(10, 0.01, 300)[:, None]
    queries = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(q)], "query_id long, vector array<double>")
    order = rng.permutation(300)
    items = spark.createDataFrame([(int(n), i[n].tolist()) for n in order], "item_id long, vector array<double>")
    got = vectors.embedding_topn(queries, items, 4, block=30).toPandas()
    scores = np.round(q @ i.T, 9)
    for n in range(40):
        assert got[got.query_id == n].sort_values("rank").item_id.tolist() == sorted(range(300), key=lambda m: (-scores[n, m], m))[:4]
    lengths = np.sort(np.linalg.norm(i, axis=1))[::-1]
    best = [(n, int(m), float(scores[n, m])) for n in range(40) for m in np.argsort(-np.linalg.norm(i, axis=1))[:30]]
    first = spark.createDataFrame(best, "query_id long, candidate_id long, score double")
    looked_at = blocks.blocks_within_reach(queries, first, lengths[::30].tolist(), 4).count()
    assert looked_at < 0.35 * 40 * 9
    # With fewer items than asked for, nothing may be skipped.
    assert vectors.embedding_topn(queries, items.filter("item_id > 292"), 9, block=3).count() == 40 * 7


def test_content_candidates_with_fallback(spark):
    catalog = spark.createDataFrame(
        [(i, f"c.{i % 4}", f"b{i % 5}", float(i)) for i in range(40)], "item_id long, category_l2 string, brand string, price double"
    )
    profiles = spark.createDataFrame(
        [(1, ["c.1"], ["b2"], [], 20.0, 4.0), (2, [], [], [], None, None), (3, ["c.0"], [], [], None, None)],
        "user_id long, top_categories array<string>, top_brands array<string>, carted_brands array<string>, price_median double, price_iqr double",
    )
    seen = spark.createDataFrame([(1, 17), (2, 0), (2, 2)] + [(3, i) for i in range(0, 40, 4)], "user_id long, item_id long")
    lists = spark.createDataFrame([(1, 33, 1), (1, 3, 2)], "user_id long, item_id long, rank int")
    got = carousel.content_candidates(profiles, seen, catalog, lists, 6, user_block=2, item_block=7).toPandas()
    listed = {33: 1.0, 3: 0.5}

    def score(i):
        return 2 * (i % 4 == 1) + 2 * (i % 5 == 2) + (abs(i - 20) <= 6) + listed.get(i, 0)

    want = sorted((i for i in range(40) if i != 17 and score(i) > 0), key=lambda i: (-score(i), i))[:6]
    assert got[got.user_id == 1].sort_values("rank").item_id.tolist() == want
    # Nothing fits user 2, and user 3 has seen everything that fits: both get the unseen catalog in item order.
    assert got[got.user_id == 2].sort_values("rank").item_id.tolist() == [1, 3, 4, 5, 6, 7]
    assert got[got.user_id == 3].sort_values("rank").item_id.tolist() == [1, 2, 3, 5, 6, 7]
