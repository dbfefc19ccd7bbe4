"""Ranking metrics and comparisons of models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import bucketize
from basketry.operators.distributed import exact_quantiles, top_rows
from basketry.operators.windows import popularity_rank
from basketry.runtime import require_columns, require_positive

# Bins of the model comparison.
REPEAT_BINS = ([-0.01, 0.0, 0.1, 0.3, 1.01], ["no_repeat (=0)", "low (0-0.1]", "mid (0.1-0.3]", "high (>0.3)"])
LENGTH_BINS = ([-1, 3, 6, 15, 50, 1e9], ["1-3", "4-6", "7-15", "16-50", "50+"])
POPULARITY_BINS = ([-1, 100, 1000, 10000, 1e9], ["top-100", "101-1k", "1k-10k", "10k+"])


def top_positions(pred: DataFrame, k: int, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """First ``k`` predictions per user with their position: by rank if there is one, else by score."""
    require_columns(pred, "user_id", "item_id")
    by_rank = "rank" in pred.columns
    order = [F.asc("rank") if by_rank else F.desc("score"), F.asc("item_id")]
    return top_rows(pred.select(*keys, "item_id", "rank" if by_rank else "score"), keys, order, k, "position")


def _ideal(n: Column, k: int) -> Column:
    """Discounted gain of ``n`` relevant items in the first places, looked up among k constants."""
    sums, total = [], 0.0
    for place in range(1, k + 1):
        total += 1.0 / math.log2(place + 1)
        sums.append(F.lit(total))
    return F.element_at(F.array(*sums), F.least(n, F.lit(k)).cast("int"))


def user_scores(pred: DataFrame, gt: DataFrame, k: int, keys: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
    """Per (keys of the predictions, groups of the truth, user) with at least one hit: NDCG, recall, reciprocal rank.

    Users without a hit are not listed: they score zero in every metric, so means only need their number.
    """
    require_positive(k=k)
    require_columns(gt, "user_id", "item_id")
    keys, groups = list(keys), list(groups)
    truth = gt.select(*groups, "user_id", "item_id").distinct()
    sizes = truth.groupBy(*groups, "user_id").agg(F.count(F.lit(1)).alias("n_truth"))
    hits = top_positions(pred, k, [*keys, "user_id"]).join(truth, ["user_id", "item_id"])
    gains = hits.groupBy(*keys, *groups, "user_id").agg(
        F.sum(1.0 / F.log2(F.col("position") + 1)).alias("_dcg"),
        F.countDistinct("item_id").alias("_hits"),
        F.min("position").alias("_first"),
    )
    return gains.join(sizes, [*groups, "user_id"]).select(
        *keys,
        *groups,
        "user_id",
        (F.col("_dcg") / _ideal(F.col("n_truth"), k)).alias("ndcg"),
        (F.col("_hits") / F.col("n_truth")).alias("recall"),
        (1.0 / F.col("_first")).alias("rr"),
    )


def _mean_over(scores: DataFrame, name: str, users: Column) -> DataFrame:
    total = F.coalesce(F.sum(name), F.lit(0.0))
    return scores.agg(F.when(users > 0, total / users).otherwise(F.lit(0.0)).alias(name))


def _n_users(gt: DataFrame) -> Column:
    return gt.select("user_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()


def ndcg_at_k(pred: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """Mean NDCG over the users that have truth; one row."""
    return _mean_over(user_scores(pred, gt, k), "ndcg", _n_users(gt))


def recall_at_k(pred: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of a user's truth found among the first ``k``; one row."""
    return _mean_over(user_scores(pred, gt, k), "recall", _n_users(gt))


def mrr_hit_at_k(pred: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """Mean reciprocal rank of the first hit, and share of users with a hit; one row."""
    users = _n_users(gt)
    return user_scores(pred, gt, k).agg(
        F.when(users > 0, F.coalesce(F.sum("rr"), F.lit(0.0)) / users).otherwise(F.lit(0.0)).alias("mrr"),
        F.when(users > 0, F.count(F.lit(1)) / users).otherwise(F.lit(0.0)).alias("hit_rate"),
    )


def evaluate_models(preds: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """NDCG and recall per model in one pass over all of them."""
    users = _n_users(gt)
    named = preds.select("model").distinct()
    sums = user_scores(preds, gt, k, keys=["model"]).groupBy("model").agg(
        F.sum("ndcg").alias("_ndcg"), F.sum("recall").alias("_recall")
    )

    def mean(name: str) -> Column:
        return F.coalesce(F.when(users > 0, F.coalesce(F.col(name), F.lit(0.0)) / users), F.lit(0.0))

    return named.join(sums, "model", "left").select("model", mean("_ndcg").alias("ndcg"), mean("_recall").alias("recall"))


def evaluate_slices(preds: DataFrame, sliced: DataFrame, slices: Sequence[str], k: int = 10) -> DataFrame:
    """NDCG, recall, users and rows per model and slice. A slice without truth gets NaN metrics and zero counts.

    ``sliced`` is the truth labelled by ``slice`` (a row may be in several slices).
    """
    sizes = sliced.groupBy("slice").agg(
        F.countDistinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_rows")
    )
    sums = user_scores(preds, sliced, k, ["model"], ["slice"]).groupBy("model", "slice").agg(
        F.sum("ndcg").alias("_ndcg"), F.sum("recall").alias("_recall")
    )
    grid = preds.select("model").distinct().select(
        "model", F.explode(F.array(*[F.lit(s) for s in slices])).alias("slice")
    )
    users = F.coalesce(F.col("n_users"), F.lit(0))

    def mean(name: str) -> Column:
        return F.when(users == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.col(name), F.lit(0.0)) / users)

    return (
        grid.join(sizes, "slice", "left")
        .join(sums, ["model", "slice"], "left")
        .select(
            "model",
            "slice",
            mean("_ndcg").alias("ndcg"),
            mean("_recall").alias("recall"),
            users.alias("n_users"),
            F.coalesce(F.col("n_rows"), F.lit(0)).alias("n_rows"),
        )
    )


def slice_inflation(results: DataFrame) -> DataFrame:
    """NDCG of the whole period against the period without the spike, per model."""
    wide = results.groupBy("model").agg(
        F.max(F.when(F.col("slice") == "full", F.col("ndcg"))).alias("full_ndcg"),
        F.max(F.when(F.col("slice") == "no_spike", F.col("ndcg"))).alias("no_spike_ndcg"),
    )
    return wide.select(
        "*",
        (F.col("full_ndcg") / F.nullif(F.col("no_spike_ndcg"), F.lit(0.0))).alias("ratio"),
        (F.col("full_ndcg") - F.col("no_spike_ndcg")).alias("delta"),
    )


def per_user_ndcg(pred: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """NDCG of every user that has both truth and predictions, zeros included."""
    served = pred.select("user_id").distinct().join(gt.select("user_id").distinct(), "user_id", "left_semi")
    return served.join(user_scores(pred, gt, k).select("user_id", "ndcg"), "user_id", "left").fillna(0.0, ["ndcg"])


def paired_ndcg(a: DataFrame, b: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """NDCG of two models for the users both serve."""
    left, right = per_user_ndcg(a, gt, k), per_user_ndcg(b, gt, k)
    return left.withColumnRenamed("ndcg", "a_ndcg").join(right.withColumnRenamed("ndcg", "b_ndcg"), "user_id")


def user_bins(history: DataFrame) -> DataFrame:
    """Repeat-ratio class and length class of each user in a history."""
    users = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("d"))
    return users.select(
        "user_id",
        bucketize(1 - F.col("d") / F.col("n"), *REPEAT_BINS).alias("repeat_bin"),
        bucketize(F.col("n"), *LENGTH_BINS).alias("length_bin"),
    )


def compare_by_bin(paired: DataFrame, bins: DataFrame, column: str) -> DataFrame:
    """Mean NDCG of both models and their difference per class of users."""
    joined = paired.join(bins.select("user_id", column), "user_id", "left").filter(F.col(column).isNotNull())
    return joined.groupBy(column).agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("a_ndcg").alias("a_ndcg"), F.avg("b_ndcg").alias("b_ndcg")
    ).withColumn("delta", F.col("a_ndcg") - F.col("b_ndcg"))


def gt_pop_rank(gt: DataFrame, history: DataFrame) -> DataFrame:
    """Truth rows with the popularity rank of the item, null for items without history."""
    return gt.join(popularity_rank(history).select("item_id", "pop_rank"), "item_id", "left")


def hit_rate_by_popularity(a: DataFrame, b: DataFrame, gt: DataFrame, history: DataFrame, k: int = 10) -> DataFrame:
    """Share of truth rows that each model has among its first ``k``, per popularity class.

    Edges are closed on the right and ranks start at 0, so the first class holds 101 items, as published.
    """
    rows = gt_pop_rank(gt, history).withColumn("pop_bin", bucketize(F.col("pop_rank"), *POPULARITY_BINS))
    for name, pred in (("a", a), ("b", b)):
        top = pred.filter(F.col("rank") <= k).select("user_id", "item_id").distinct().withColumn(f"_{name}", F.lit(1))
        rows = rows.join(top, ["user_id", "item_id"], "left")
    return rows.filter(F.col("pop_bin").isNotNull()).groupBy("pop_bin").agg(
        F.count(F.lit(1)).alias("n_gt"),
        F.avg(F.coalesce(F.col("_a"), F.lit(0))).alias("a_hit_rate"),
        F.avg(F.coalesce(F.col("_b"), F.lit(0))).alias("b_hit_rate"),
    ).withColumn("delta", F.col("a_hit_rate") - F.col("b_hit_rate"))


def win_loss(paired: DataFrame) -> DataFrame:
    """Mean and median difference of two models and the shares of wins, losses, ties and ties at zero."""
    # Equal lists can differ in the last digits of their sums; such differences count as ties.
    rows = paired.select("a_ndcg", F.round(F.col("a_ndcg") - F.col("b_ndcg"), 9).alias("delta"))
    d = F.col("delta")

    def share(condition: Column, name: str) -> Column:
        return F.avg(condition.cast("double")).alias(name)

    median = exact_quantiles(rows, [], "delta", {"m": 0.5}).select("m").scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg(d).alias("mean_delta"),
        share(d > 0, "share_a_wins"),
        share(d < 0, "share_b_wins"),
        share(d == 0, "share_ties"),
        share((d == 0) & (F.col("a_ndcg") == 0), "share_zero_ties"),
    ).withColumn("median_delta", median)
