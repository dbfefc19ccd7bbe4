"""Learning steps, sequences and checks of explanations on small tables."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketry.operators import als, features, gate, metrics, prompts, rerank, sequences, splits
from basketry.plans import registry
from basketry.plans.common import MODELS, parts, preds
from basketry.runtime import cut


def test_augmentation_keeps_shape(spark):
    rows = [(u, n, [*range(1, n + 1), *[0] * (8 - n)]) for u, n in enumerate([0, 1, 2, 5, 8])]
    df = spark.createDataFrame(rows, "user_id long, length int, sequence array<long>")
    for kind in ("crop", "mask", "reorder", "random"):
        got = {r.user_id: r for r in sequences.augment_sequences(df, kind, 0.4, 50).collect()}
        for user, n, old in rows:
            new = got[user]
            body = list(new.sequence)[: new.length]
            assert len(new.sequence) == 8 and list(new.sequence)[new.length :] == [0] * (8 - new.length)
            if kind == "crop":
                keep = n if n <= 1 else max(1, int(n * (1 - 0.4)))
                assert new.length == keep and (not body or body == list(range(body[0], body[0] + keep)))
            elif kind in ("mask", "reorder"):
                assert new.length == n
                if kind == "reorder":
                    assert sorted(body) == list(range(1, n + 1)) and (n > 2 or body == old[:n])
    with pytest.raises(ValueError):
        sequences.augment_sequences(df, "other", 0.4, 50)


def test_long_histories_go_on_in_further_rows(spark, sf):
    registry.load_all()
    rows = registry.QUERIES["user_sequences"](spark, sf).collect()
    assert max(r.chunk for r in rows) >= 1 and all(len(r["items"].split("|")) <= 25 for r in rows)


def test_parse_ranked_list(spark):
    items = [f"i{n}" for n in range(12)]
    texts = ['x ["C01", 3, "c11", "C01", "C77"] ["C00"]', "['C02']", "[]", "none", '["C00", oops]']
    df = spark.createDataFrame([(n, t, items) for n, t in enumerate(texts)], "id int, text string, candidates array<string>")
    got = {r.id: r["items"] for r in prompts.parse_ranked_list(df).collect()}
    assert got == {0: ["i1", "i11"], 1: ["i2"], 2: None, 3: None, 4: None}


def test_self_check_rules(spark):
    claim = "claims array<struct<text: string, evidence_ref: string>>"
    rows = [
        ("a", 0, [("t", "k1"), ("t", "k2")]), ("a", 1, [("t", "k1")]), ("a", 2, [("t", "k1"), ("t", "k3")]),
        ("b", 0, [("t", "k1")]), ("c", 0, []), ("c", 1, [("t", "k1")]),
    ]
    df = spark.createDataFrame(rows, f"response_id string, sample int, {claim}")
    assert {r.response_id: r.score for r in gate.self_check(df).collect()} == {"a": 0.5, "b": 1.0, "c": 0.0}
    flags = {r.response_id: r["flags"] for r in gate.self_check_flags(df).collect()}
    assert flags["a"] == ["⚠ wobbly: k2 (0% 일관)"] and flags["b"] == []


def test_calibration(spark):
    rng = np.random.default_rng(0)
    conf = rng.uniform(0.01, 0.99, 400)
    label = (rng.random(400) < 1 / (1 + np.exp(-np.log(conf / (1 - conf)) / 2.5))).astype(int)
    df = spark.createDataFrame([(float(c), int(y)) for c, y in zip(conf, label)], "confidence double, label int")

    def loss(t):
        p = np.clip(1 / (1 + np.exp(-np.log(conf / (1 - conf)) / t)), 1e-7, 1 - 1e-7)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    fine = np.geomspace(0.05, 10, 20001)
    best = fine[np.argmin([loss(t) for t in fine])]
    assert gate.fit_temperature(df).first().temperature == pytest.approx(best, rel=3e-3)
    assert gate.fit_temperature(df.limit(2)).first().temperature == 1.0
    assert gate.expected_calibration_error(df.limit(0)).first().ece == 0.0


def test_als_serves_known_users(spark, sf):
    p = parts(spark, sf)
    inter = features.interaction_matrix(p.train)
    got = als.als_recommend(inter, p.users, 10, filter_seen=True, rank=8, iterations=3).cache()
    assert got.join(inter, ["user_id", "item_id"]).count() == 0
    assert {r["count"] for r in got.groupBy("user_id").count().collect()} == {10}


def test_rerankers_learn(spark, sf):
    """Both rerankers put bought items first when a feature gives them away, and folds never see their own users."""
    p = parts(spark, sf)
    table, names = rerank.training_table(
        features.candidate_features(preds(p.train), MODELS, p.train, p.truth, p.users).withColumn(
            "hint", F.col("label") * 2.0 + F.rand(1)
        ),
        folds=2,
    )
    truth = table.filter("label = 1").select("user_id", "item_id")
    for fit in (lambda: rerank.rerank_binary(table, 2, trees=3, depth=2), lambda: rerank.rerank_pairwise(table, 2)):
        oof, models = fit()
        assert oof.count() == table.count() and len(models) == 2
        # Trees split at quantiles, so a few others share a leaf with the bought items.
        assert metrics.ndcg_at_k(rerank.ranked(oof), truth).first()[0] > 0.85
    assert splits.user_folds(table, 2).count() == table.select("user_id").distinct().count()
    assert "hint" in names


def test_rerank_binary_query_fits_all_folds_and_trees(spark, sf, monkeypatch):
    """The query fits what the operator does by itself: every fold, each with all trees in full depth."""
    registry.load_all()
    fit, seen = rerank.rerank_binary, []
    monkeypatch.setattr(rerank, "rerank_binary", lambda *a, **b: seen.append((a[0], *fit(*a, **b))) or seen[-1][1:])
    lists = registry.QUERIES["rerank_binary"](spark, sf)
    ((table, oof, models),) = seen
    assert [(m.getNumTrees, m.getOrDefault("maxDepth")) for m in models] == [(20, 5)] * 5
    assert {r.fold for r in table.select("fold").distinct().collect()} == set(range(5))
    assert oof.select("user_id", "item_id", "fold").exceptAll(table.select("user_id", "item_id", "fold")).isEmpty()
    assert oof.count() == table.count()
    sizes = {r.user_id: min(10, r["count"]) for r in table.groupBy("user_id").count().collect()}
    assert {r.user_id: r["count"] for r in lists.groupBy("user_id").count().collect()} == sizes


def test_training_table_is_dealt_over_all_tasks(spark):
    """Stored candidates, small as a file, do not end up in the one task that holds the folds."""
    rows = spark.range(20000).select(
        (F.col("id") % 1000).alias("user_id"), F.floor(F.col("id") / 1000).alias("item_id"),
        (F.col("id") % 7 == 0).cast("int").alias("label"), (F.col("id") % 10 != 0).cast("int").alias("is_eval_user"),
        *(F.rand(i).alias(f"x{i}") for i in range(30)),
    )
    candidates = cut(rows)
    table, names = rerank.training_table(candidates, folds=3)
    dealt = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    assert len(names) == 30 and sum(dealt) == 18000 and max(dealt) < 0.4 * sum(dealt)
    chosen = candidates.filter("is_eval_user = 1")
    wanted = chosen.join(splits.user_folds(chosen, 3), "user_id").select("user_id", "item_id", "label", "fold", "x29")
    found = table.select("user_id", "item_id", F.col("label").cast("int"), "fold", vector_to_array("features")[29].alias("x29"))
    assert found.exceptAll(wanted).isEmpty()


def test_fold_models_score_everyone_and_survive_storage(spark, sf, tmp_path):
    p = parts(spark, sf)
    candidates = features.candidate_features(preds(p.train), MODELS, p.train, p.truth, p.users).cache()
    table, names = rerank.training_table(candidates, folds=2)
    everyone = rerank.scoring_table(candidates, names)
    assert everyone.count() == candidates.count() > table.count()
    with pytest.raises(ValueError, match="features missing: unheard_of"):
        rerank.scoring_table(candidates, [*names, "unheard_of"])
    fits = {
        "trees": rerank.rerank_binary(table, 2, trees=3, depth=2, stop_early=True, least_leaf=2, feature_share=0.5),
        "pairs": rerank.rerank_pairwise(table, 2),
    }
    for kind, (_, models) in fits.items():
        rerank.save_fold_models(models, str(tmp_path / kind))
        again = rerank.load_fold_models(str(tmp_path / kind), 2)
        scores = rerank.score_fold_average(everyone, models).collect()
        assert sorted(scores) == sorted(rerank.score_fold_average(everyone, again).collect())
        assert len({(r.user_id, r.item_id) for r in scores}) == len(scores) == candidates.count()


def test_functions_travel_without_the_package(tmp_path):
    """A worker that cannot import the package runs what the driver sends."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from basketry.operators import block_matrix

    path = tmp_path / "function"
    path.write_bytes(cloudpickle.dumps(block_matrix.dense))
    code = f"import pickle, sys; f = pickle.load(open({str(path)!r}, 'rb')); assert f(bytes(32), 2).shape == (2, 2); assert 'basketry' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
