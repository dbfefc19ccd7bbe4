"""Popularity, filling short lists and checking a submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.distributed import top_rows
from basketry.runtime import require_columns, require_positive


def popularity(df: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most purchased items with their rank."""
    require_columns(df, "item_id", "event_type")
    require_positive(n=n)
    counts = df.filter(F.col("event_type") == "purchase").groupBy("item_id").agg(F.count(F.lit(1)).alias("purchases"))
    best = counts.orderBy(F.desc("purchases"), F.asc("item_id")).limit(n)
    # At most n rows are left, so they fit one sorted array.
    ordered = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("purchases")).alias("m"), "item_id"))).alias("a"))
    return ordered.select(F.posexplode("a").alias("rank", "row")).select(
        F.col("row.item_id").alias("item_id"), (-F.col("row.m")).alias("purchases"), (F.col("rank") + 1).alias("rank")
    )


def fill_with_popularity(pred: DataFrame, users: DataFrame, pop: DataFrame, k: int = 10) -> DataFrame:
    """Exactly ``k`` items per user: the user's own best ones, then popular items not among them.

    ``pop`` has ``item_id`` and ``rank``. A user keeps at most k items, so the first k popular ones always suffice;
    they travel as one array inside the plan. The job fails if there are fewer than k popular items.
    """
    require_positive(k=k)
    require_columns(pred, "user_id", "item_id")
    require_columns(pop, "item_id", "rank")
    order = F.col("rank") if "rank" in pred.columns else -F.col("score")
    best = pred.select("user_id", "item_id", order.cast("double").alias("_order")).groupBy("user_id", "item_id").agg(
        F.min("_order").alias("_order")
    )
    # row_number <= k is applied before the shuffle, so the list below never holds more than k items.
    own = (
        top_rows(best, ["user_id"], [F.asc("_order"), F.asc("item_id")], k)
        .groupBy("user_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("_own"))
    )
    shelf = (
        pop.groupBy("item_id").agg(F.min("rank").alias("rank")).orderBy("rank", "item_id").limit(k)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("_pool"))
        .select(
            F.when(F.size("_pool") >= k, F.col("_pool")).otherwise(
                F.raise_error(F.format_string(f"need {k} popular items, have %d", F.size("_pool")))
            )
        )
        .scalar()
    )
    picked = F.coalesce(F.col("_own"), F.array().cast(own.schema["_own"].dataType))
    filled = F.slice(F.concat(picked, F.array_except(shelf, picked)), 1, k)
    return (
        users.select("user_id").distinct()
        .join(own, "user_id", "left")
        .select("user_id", F.posexplode(filled).alias("_position", "item_id"))
        .select("user_id", "item_id", (F.col("_position") + 1).alias("rank"))
    )


def validate_submission(df: DataFrame, expected_users: int, k: int = 10) -> DataFrame:
    """One row per check with its outcome and the number of offenders."""
    columns_ok = df.columns[:2] == ["user_id", "item_id"] and set(df.columns) <= {"user_id", "item_id", "rank"}
    require_columns(df, "user_id", "item_id")
    pairs = df.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    users = pairs.groupBy("user_id").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_items"), F.max("_n").alias("_most")
    )
    totals = users.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("_rows") != k).alias("wrong_count"),
        F.count_if(F.col("_most") > 1).alias("duplicates"),
    )
    def outcome(name: str, passed, found):
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), found.cast("long").alias("found"))

    checks = F.array(
        outcome("columns", F.lit(columns_ok), F.lit(0 if columns_ok else 1)),
        outcome("row count", F.col("rows") == expected_users * k, F.col("rows")),
        outcome("user count", F.col("users") == expected_users, F.col("users")),
        outcome("items per user", F.col("wrong_count") == 0, F.col("wrong_count")),
        outcome("duplicates", F.col("duplicates") == 0, F.col("duplicates")),
    )
    return totals.select(F.inline(checks))


def submission_offenders(df: DataFrame, k: int = 10, n: int = 5) -> DataFrame:
    """A few users whose list has the wrong length or a repeated item."""
    pairs = df.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    users = pairs.groupBy("user_id").agg(F.sum("_n").alias("rows"), (F.max("_n") > 1).alias("has_duplicates"))
    return users.filter((F.col("rows") != k) | F.col("has_duplicates")).orderBy("user_id").limit(n)
