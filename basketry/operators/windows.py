"""Ranking and normalising inside a user's list, and positions over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions.scalars import alias_parts, brand_slug, price_bucket
from basketry.operators.distributed import keyed_position, most_frequent, sorted_index, top_rows


def rank_within_user(df: DataFrame, n: int, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Rank 1..n by score, best first."""
    return top_rows(df.drop("rank"), keys, [F.desc("score"), F.asc("item_id")], n)


def minmax_within_user(df: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Score scaled to 0..1 inside each user's list; a flat list becomes 1. Lists are already cut to their top."""
    whole = W.partitionBy(*keys)
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    return df.withColumn("norm_score", scaled)


def zscore_global(df: DataFrame) -> DataFrame:
    """Score in sample standard deviations from the mean of its model over all users; 0 if there is no spread.

    There is one statistics row per model, so the join side is as small as the list of models.
    """
    stats = df.groupBy("model").agg(F.avg("score").alias("_mean"), F.stddev_samp("score").alias("_std"))
    spread = F.when(F.coalesce(F.col("_std"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        (F.col("score") - F.col("_mean")) / F.col("_std")
    )
    return df.join(F.broadcast(stats), "model").withColumn("norm_score", spread).drop("_mean", "_std")


def last_n_events(df: DataFrame, n: int, tie: str = "event_id") -> DataFrame:
    """Newest ``n`` events per user; 1 is the newest."""
    return top_rows(df, ["user_id"], [F.desc("event_time"), F.desc(tie)], n, "recency")


def popularity_rank(df: DataFrame) -> DataFrame:
    """0-based rank of each item by number of events."""
    counts = df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return sorted_index(counts, [F.desc("n"), F.asc("item_id")], "pop_rank")


def item_aliases(items: DataFrame, band=None) -> DataFrame:
    """Readable alias ``l2.l3.brand.price_0001`` per item: a running number inside each combination.

    ``items`` has ``item_id, category_code, brand, price``. ``band`` cuts a large combination along the item id
    (default: blocks of 65,536 for numeric ids, the first two characters for text).
    """
    second, third = alias_parts(F.col("category_code"))
    key = F.concat_ws(".", second, third, brand_slug(F.col("brand")), price_bucket(F.col("price")))
    if band is None:
        numeric = items.schema["item_id"].dataType.typeName() != "string"
        band = F.floor(F.col("item_id") / 65536) if numeric else F.substring("item_id", 1, 2)
    numbered = keyed_position(items.withColumn("_key", key), ["_key"], ["item_id"], band, "_n")
    number = (F.col("_n") + 1).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return numbered.select("item_id", F.concat_ws("_", F.col("_key"), padded).alias("item_alias"))


def alias_items(df: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Items of the log (and of ``extra``) with most frequent category and brand and mean price."""
    prices = df.groupBy("item_id").agg(F.avg("price").alias("price"))
    meta = prices.join(most_frequent(df, ["item_id"], ["category_code", "brand"]), "item_id", "left")
    if extra is None:
        return meta
    return meta.join(extra.select("item_id").distinct(), "item_id", "full_outer")


def user_aliases(users: DataFrame) -> DataFrame:
    """``user_00001`` and so on in the order of the ids."""
    indexed = sorted_index(users.select("user_id").distinct(), ["user_id"], "_n")
    number = (F.col("_n") + 1).cast("string")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    return indexed.select("user_id", F.concat(F.lit("user_"), padded).alias("user_alias"))
