"""Time-decayed item frequencies per user and scoring with neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import with_event_weight
from basketry.operators.distributed import keyed_position, top_rows

DIGITS = 9  # weights and scores are kept to this many places, so that equal ones compare equal


def recency_groups(
    df: DataFrame, groups: int = 7, r_within: float = 0.9, r_across: float = 0.7, tie: str = "event_id"
) -> DataFrame:
    """Decay of each event by its group among equal-sized groups of the user's history and by its place in the group."""
    hour = F.date_trunc("hour", F.col("event_time"))
    placed = keyed_position(df, ["user_id"], ["event_time", tie], hour, "position", "length")
    n = F.least(F.lit(groups), F.col("length"))
    size = F.col("length").cast("double") / n
    group = F.least(F.floor(F.col("position") / size), n - 1)
    grouped = placed.withColumns({"_n": n, "_size": size, "group": group})
    start = F.floor(F.col("group") * F.col("_size"))
    end = F.when(F.col("group") < F.col("_n") - 1, F.floor((F.col("group") + 1) * F.col("_size"))).otherwise(F.col("length"))
    grouped = grouped.withColumns({"group_position": F.col("position") - start, "_len": F.greatest(F.lit(1), end - start)})
    decay = F.pow(F.lit(r_across), F.col("_n") - 1 - F.col("group")) * F.pow(
        F.lit(r_within), F.col("_len") - 1 - F.col("group_position")
    )
    return grouped.withColumn("decay", decay).drop("_n", "_size", "_len")


def tifu_vectors(
    df: DataFrame,
    groups: int = 7,
    r_within: float = 0.9,
    r_across: float = 0.7,
    weights: dict[str, float] | None = None,
    tie: str = "event_id",
) -> DataFrame:
    """Decayed and weighted item frequencies ``(user_id, item_id, weight)``."""
    events = with_event_weight(df.select("user_id", "item_id", "event_type", "event_time", tie), weights, "_event_weight")
    decayed = recency_groups(events, groups, r_within, r_across, tie)
    return decayed.groupBy("user_id", "item_id").agg(
        F.round(F.sum(F.col("decay") * F.col("_event_weight")), DIGITS).alias("weight")
    )


def tifu_scores(vec: DataFrame, knn: DataFrame, alpha: float = 0.7, k: int = 300, n: int = 50) -> DataFrame:
    """Own frequencies times alpha plus the neighbours' mean times the rest; best ``n`` items per user.

    The mean always divides by ``k``, also when a user has fewer neighbours.
    """
    own = vec.select("user_id", "item_id", (alpha * F.col("weight")).alias("part"))
    near = (
        knn.select("user_id", "neighbor")
        .join(vec.select(F.col("user_id").alias("neighbor"), "item_id", "weight"), "neighbor")
        .groupBy("user_id", "item_id")
        .agg((F.sum("weight") * ((1.0 - alpha) / k)).alias("part"))
    )
    scores = own.unionByName(near).groupBy("user_id", "item_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return top_rows(scores.filter(F.col("score") > 0), ["user_id"], [F.desc("score"), F.asc("item_id")], n)
