"""Ranking trees: gradients against brute force, growth, out-of-fold scores and storage."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from basketry.operators import metrics, ranking_trees, rerank


def batch_of(draw, users=50, width=3, folds=2):
    sizes = draw.integers(1, 12, users)
    rows = {
        "user_id": list(range(users)),
        "fold": [int(u % folds) for u in range(users)],
        "item_ids": [list(range(n)) for n in sizes],
        "labels": [draw.integers(0, 3, n).astype(float).tolist() for n in sizes],
        "bins": [draw.integers(0, 5, (n, width)).astype(np.uint8).tobytes() for n in sizes],
        "scores": [np.zeros((n, folds)).tobytes() for n in sizes],
    }
    return pa.RecordBatch.from_pydict(rows)


def test_gradients_equal_brute_force():
    draw = np.random.default_rng(0)
    batch = batch_of(draw)
    users = ranking_trees.Users.of(batch, 3, 2, k=4)
    scores = np.round(draw.standard_normal(len(users.labels)), 1)
    g, h = users.gradients(scores)
    ndcg = users.ndcg(scores)
    first = 0
    for number, labels in enumerate(batch.column("labels").to_pylist()):
        n = len(labels)
        mine = scores[first : first + n]
        place = {row: p for p, row in enumerate(sorted(range(n), key=lambda i: (-mine[i], i)))}
        best = sorted(labels, reverse=True)
        ideal = sum((2**y - 1) / math.log2(p + 2) for p, y in enumerate(best))
        want_g, want_h = np.zeros(n), np.zeros(n)
        for i in range(n):
            for j in range(n):
                if labels[i] > labels[j]:
                    swap = abs((2 ** labels[i] - 2 ** labels[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
                    rho = 1 / (1 + math.exp(mine[i] - mine[j]))
                    want_g[i] -= swap * rho
                    want_g[j] += swap * rho
                    want_h[i] += swap * rho * (1 - rho)
                    want_h[j] += swap * rho * (1 - rho)
        assert np.allclose(g[first : first + n], want_g) and np.allclose(h[first : first + n], want_h)
        top = sum((2**y - 1) / math.log2(p + 2) for p, y in enumerate(best[:4]))
        got = sum((2 ** labels[i] - 1) / math.log2(p + 2) for i, p in place.items() if p < 4)
        assert (math.isnan(ndcg[number]) and top == 0) or ndcg[number] == pytest.approx(got / top)
        first += n


def test_split_equals_brute_force():
    draw = np.random.default_rng(1)
    sums = np.concatenate([draw.standard_normal((4, 6, 1)), draw.random((4, 6, 1)), draw.integers(0, 9, (4, 6, 1))], axis=2)
    sums[1:] *= (sums[0].sum(axis=0) / sums[1:].sum(axis=1))[:, None]
    s = ranking_trees.Settings(least_leaf=5)
    best = (0.0, 0, 0)
    for f in (0, 1, 3):
        total = sums[0].sum(axis=0)
        for b in range(5):
            left = sums[f, : b + 1].sum(axis=0)
            right = total - left
            gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - total[0] ** 2 / (total[1] + 1)
            if left[2] >= 5 and right[2] >= 5 and gain > best[0]:
                best = (gain, f, b)
    found = ranking_trees._best_split(sums, np.array([True, True, False, True]), s)
    assert found[0] == pytest.approx(best[0]) and found[1:] == best[1:]


def training(spark, users=150, folds=3):
    """Candidates whose label follows a bend in one feature, so that no linear score finds it; another feature has nulls for zeros."""
    draw = np.random.default_rng(7)
    rows = []
    for u in range(users):
        x = draw.random((12, 3))
        bent = -np.abs(x[:, 1] - 0.5) + 0.02 * draw.standard_normal(12)
        for i in range(12):
            rows.append((u, i, float(bent[i] >= np.sort(bent)[-2]), [float(v) for v in x[i]], u % folds))
    df = spark.createDataFrame(rows, "user_id long, item_id long, label double, x array<double>, fold int")
    return df.select("user_id", "item_id", "label", array_to_vector("x").alias("features"), "fold")


SMALL = ranking_trees.Settings(trees=12, depth=3, step=0.3, least_leaf=5, refresh=4, bins=32)


def test_trees_find_what_a_line_cannot(spark, tmp_path):
    table = training(spark)
    names = ["a", "b", "c"]
    oof, models = ranking_trees.rerank_lambda(table, names, 3, SMALL)
    truth = table.filter("label = 1").select("user_id", "item_id")
    ours = metrics.ndcg_at_k(rerank.ranked(oof), truth).first()[0]
    linear, _ = rerank.rerank_pairwise(table, 3)
    assert oof.count() == table.count() and ours > 0.9 > metrics.ndcg_at_k(rerank.ranked(linear), truth).first()[0]
    assert ranking_trees.ranking_gain(models, spark).first().feature == "b"
    # Stored scores, refreshed every few trees, are the models' scores.
    again = {(r.user_id, r.item_id): r.score for r in oof.collect()}
    for r in table.collect():
        model = models[r.fold]
        assert again[r.user_id, r.item_id] == pytest.approx(model.scores(model.bins(r.features.toArray()[None]))[0], abs=1e-8)
    path = str(tmp_path / "models")
    ranking_trees.save_ranking_models(models, spark, path)
    loaded = ranking_trees.load_ranking_models(spark, path)
    everyone = table.select("user_id", "item_id", "features")
    first, second = (sorted(ranking_trees.score_ranking_average(everyone, m, 5).collect()) for m in (models, loaded))
    assert first == second and len(first) == 150 * 5


def test_models_do_not_depend_on_partitions(spark):
    table = training(spark, users=40)
    found = [ranking_trees.rerank_lambda(t, ["a", "b", "c"], 3, SMALL)[1] for t in (table.coalesce(1), table.repartition(7, F.rand(3)))]
    for one, other in zip(*found):
        assert len(one.trees) == len(other.trees)
        for a, b in zip(one.trees, other.trees):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_tables_without_pairs(spark):
    table = training(spark, users=10)
    for part in (table.filter("label = 0"), table.filter("item_id = 1"), table.limit(0)):
        oof, models = ranking_trees.rerank_lambda(part, ["a", "b", "c"], 3, SMALL)
        assert {r.score for r in oof.collect()} <= {0.0} and oof.count() == part.count() and not any((t.feature >= 0).any() for m in models for t in m.trees)


def test_work_on_users_in_slices():
    """Nodes found column by column are those of a walk down the tree; histograms are those of all rows, slice or not."""
    draw = np.random.default_rng(3)
    tree = ranking_trees.Tree.of(3)
    for node in (0, 1, 2, 4, 5):
        tree.feature[node], tree.cut[node] = draw.integers(0, 3), draw.integers(0, 4)
    bins = draw.integers(0, 6, (400, 3)).astype(np.uint8)

    def walk(row):
        node = 0
        while node < 7 and tree.feature[node] >= 0:
            node = 2 * node + 1 + int(row[tree.feature[node]] > tree.cut[node])
        return node

    assert tree.nodes(np.ascontiguousarray(bins.T)).tolist() == [walk(row) for row in bins]
    batch = batch_of(draw, users=90)
    whole = ranking_trees.Users.of(batch, 3, 2, k=4)
    scores = np.round(draw.standard_normal(len(whole.labels)), 1)
    use, place = draw.random(len(scores)) < 0.7, draw.integers(0, 2, len(scores))
    found = np.zeros((2, 3, 8, 3), np.int64)
    ranking_trees._add_histograms(found, whole, use, place, scores)
    g, h = whole.gradients(scores)
    want = np.zeros_like(found)
    for row in np.flatnonzero(use):
        for j in range(3):
            want[place[row], j, whole.columns[j, row]] += np.array([round(g[row] / ranking_trees.UNIT), round(h[row] / ranking_trees.UNIT), 1])
    assert (found == want).all()
    parts, first = np.zeros_like(found), 0
    for begin in range(0, 90, 13):
        part = ranking_trees.Users.of(batch.slice(begin, 13), 3, 2, k=4)
        rows = slice(first, first := first + len(part.labels))
        ranking_trees._add_histograms(parts, part, use[rows], place[rows], scores[rows])
    assert (parts == want).all()
