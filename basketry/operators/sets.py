"""Set operations on ids and prediction lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.distributed import exact_quantiles
from basketry.runtime import union_all


def all_ids(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """Distinct ids that occur in any of the tables."""
    return union_all(t.select(column).distinct() for t in tables).distinct()


def users_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Users of the first table that the second does not have."""
    return a.select("user_id").distinct().join(b.select("user_id").distinct(), "user_id", "left_anti")


def users_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Users that both tables have."""
    return a.select("user_id").intersect(b.select("user_id"))


def covers(target: DataFrame, log: DataFrame) -> DataFrame:
    """One row: whether every target user occurs in the log."""
    return users_missing(target, log).agg((F.count(F.lit(1)) == 0).alias("covered"))


def prediction_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Number of common items in two models' first ``k``, for users that both models serve.

    Both lists go through one grouping by pair and one by user instead of a join of the lists.
    """
    both = union_all(
        [df.filter(F.col("rank") <= k).select("user_id", "item_id", F.lit(bit).alias("_side")) for df, bit in ((a, 1), (b, 2))]
    )
    pairs = both.groupBy("user_id", "item_id").agg(F.bit_or("_side").alias("_sides"))
    users = pairs.groupBy("user_id").agg(F.count_if(F.col("_sides") == 3).alias("overlap"), F.bit_or("_sides").alias("_any"))
    return users.filter(F.col("_any") == 3).select("user_id", "overlap")


def overlap_summary(overlap: DataFrame, k: int = 10) -> DataFrame:
    """Mean, quartiles and the shares of users without and with complete overlap."""
    n = F.col("overlap")
    totals = overlap.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.round(F.avg(n), 6).alias("mean_overlap"),
        F.avg((n == 0).cast("double")).alias("share_none"),
        F.avg((n == k).cast("double")).alias("share_full"),
    )
    quartiles = exact_quantiles(overlap, [], "overlap", {"p25": 0.25, "median_overlap": 0.5, "p75": 0.75})
    row = quartiles.select(F.struct("*").alias("q")).scalar()
    return totals.withColumn("_q", row).select(
        "n_users", "mean_overlap", "share_none", "share_full", "_q.p25", "_q.median_overlap", "_q.p75"
    )
