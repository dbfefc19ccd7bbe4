import math

import pytest

from basketry.operators import fusion, metrics, submission


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first()[0]


@pytest.fixture
def shelf(spark):
    """Four readers, five books: lists of different lengths, so that every reader has another score."""
    truth = table(spark, [("ann", "sea"), ("ann", "oak"), ("ben", "fog"), ("cat", "ink"), ("dan", "sea")], "user_id string, item_id string")
    lists = {"ann": ["oak", "ink", "sea", "fog"], "ben": ["ink", "oak", "sea", "fog"], "cat": ["ink"], "dan": ["rye", "fog"]}
    pred = table(spark, [(u, i, r) for u, items in lists.items() for r, i in enumerate(items, 1)], "user_id string, item_id string, rank int")
    return pred, truth


def test_ndcg_and_recall_by_hand(shelf):
    pred, truth = shelf
    # ann: places 1 and 3 of an ideal 1 and 2; ben: place 4; cat: place 1; dan: none.
    gain = [1 / math.log2(place + 1) for place in range(1, 5)]
    scores = {"ann": (gain[0] + gain[2]) / (gain[0] + gain[1]), "ben": gain[3], "cat": 1.0, "dan": 0.0}
    per_user = {r.user_id: r.ndcg for r in metrics.per_user_ndcg(pred, truth).collect()}
    assert per_user == pytest.approx(scores)
    assert one(metrics.ndcg_at_k(pred, truth)) == pytest.approx(sum(scores.values()) / 4)
    assert one(metrics.recall_at_k(pred, truth)) == pytest.approx(3 / 4)
    assert one(metrics.recall_at_k(pred, truth, 2)) == pytest.approx((0.5 + 0 + 1 + 0) / 4)


def test_metrics_of_odd_lists(spark, shelf):
    pred, truth = shelf
    with pytest.raises(ValueError):
        metrics.ndcg_at_k(pred, truth, 0)
    assert one(metrics.ndcg_at_k(pred, truth.limit(0))) == 0.0
    # A reader with truth but without a list counts as zero; lists without truth are ignored.
    assert one(metrics.ndcg_at_k(pred.filter("user_id = 'cat'"), truth)) == pytest.approx(1 / 4)
    extra = pred.unionByName(table(spark, [("eve", "sea", 1)], pred.schema))
    assert one(metrics.recall_at_k(extra, truth)) == pytest.approx(3 / 4)
    # Order by score when there is no rank; a repeated item counts once in recall.
    scored = table(spark, [("ben", "ink", -3.0), ("ben", "fog", 2.5)], "user_id string, item_id string, score double")
    only = truth.filter("user_id = 'ben'")
    assert one(metrics.ndcg_at_k(scored, only)) == pytest.approx(1.0)
    twice = table(spark, [("ben", "fog", 1), ("ben", "fog", 2)], "user_id string, item_id string, rank int")
    assert one(metrics.recall_at_k(twice, only)) == pytest.approx(1.0)


def test_fusion_ties_and_checks(spark):
    schema = "user_id string, item_id string, rank int"
    one_list = table(spark, [("u", i, r) for r, i in enumerate(["oak", "ink", "sea"], 1)], schema)
    other = table(spark, [("u", i, r) for r, i in enumerate(["rye", "ink", "oak"], 1)], schema)
    fused = fusion.rrf_lists([one_list, other], n=3).orderBy("rank").collect()
    # oak: places 1 and 3; ink: twice place 2; rye: place 1 only, sea: place 3 only.
    assert [r.item_id for r in fused] == ["oak", "ink", "rye"]
    assert fused[1].score == pytest.approx(2 / 62, abs=1e-8)
    tied = fusion.rrf_lists([one_list.filter("rank = 1"), other.filter("rank = 1")], n=2).orderBy("rank").collect()
    assert [r.item_id for r in tied] == ["oak", "rye"] and tied[0].score == tied[1].score
    for lists, options in (([], {}), ([one_list, other], {"weights": [2.0]}), ([other.drop("rank")], {})):
        with pytest.raises(ValueError):
            fusion.rrf_lists(lists, **options)


def test_submission(spark):
    sold = {"tea": 9, "rice": 7, "salt": 7, "soap": 3, "wax": 1}
    log = table(
        spark,
        [("u", item, "purchase") for item, n in sold.items() for _ in range(n)] + [("u", "wax", "cart")] * 20,
        "user_id string, item_id string, event_type string",
    )
    pop = submission.popularity(log, 50)
    assert [(r.item_id, r.purchases) for r in pop.orderBy("rank").collect()] == list(sold.items())
    pred = table(
        spark,
        [("ann", "wax", 1), ("ann", "wax", 2), ("ann", "tea", 3), ("ben", "ink", 1), ("ben", "soap", 2), ("ben", "oak", 3), ("ben", "fog", 4)],
        "user_id string, item_id string, rank int",
    )
    users = table(spark, [("ann",), ("ben",), ("new",)], "user_id string")
    filled = submission.fill_with_popularity(pred, users, pop, 3)
    lists = {}
    for r in filled.orderBy("user_id", "rank").collect():
        lists.setdefault(r.user_id, []).append(r.item_id)
    assert lists == {"ann": ["wax", "tea", "rice"], "ben": ["ink", "soap", "oak"], "new": ["tea", "rice", "salt"]}
    assert all(r.passed for r in submission.validate_submission(filled.drop("rank"), 3, 3).collect())
    short = filled.filter("not (user_id = 'new' and rank = 3)")
    failed = {r.check for r in submission.validate_submission(short.drop("rank"), 3, 3).collect() if not r.passed}
    assert failed == {"row count", "items per user"}
    assert [r.user_id for r in submission.submission_offenders(short, 3).collect()] == ["new"]
    same = filled.replace({"rice": "tea"}, subset="item_id")
    assert not {r.check: r.passed for r in submission.validate_submission(same.drop("rank"), 3, 3).collect()}["duplicates"]
    with pytest.raises(Exception, match="need 6 popular items"):
        submission.fill_with_popularity(pred, users, pop, 6).collect()
