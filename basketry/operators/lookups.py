"""Joins that attach ids, metadata and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.runtime import cut, require_columns

BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table only after counting it; a larger one is joined by shuffle.

    The table is cut first, so counting and joining read the same files and its aggregate runs once.
    """
    stored = cut(df)
    # Text is counted with 64 bytes per value, other types with their fixed width.
    width = sum(64 if f.dataType.typeName() == "string" else 16 for f in stored.schema.fields)
    return F.broadcast(stored) if stored.count() * width <= limit else stored


def add_idx_columns(df: DataFrame, user_map: DataFrame, item_map: DataFrame) -> DataFrame:
    """Map user and item ids to integers. The job fails on the first id that a map does not know."""
    require_columns(df, "user_id", "item_id")
    joined = df.join(item_map, "item_id", "left").join(user_map, "user_id", "left")
    for key in ("user", "item"):
        unknown = F.raise_error(F.format_string(f"{key}_id without index: %s", F.col(f"{key}_id").cast("string")))
        joined = joined.withColumn(
            f"{key}_idx", F.when(F.col(f"{key}_idx").isNull(), unknown).otherwise(F.col(f"{key}_idx"))
        )
    return joined


def unknown_ids(df: DataFrame, user_map: DataFrame, item_map: DataFrame) -> DataFrame:
    """How many distinct users and items of the log have no index, to check before mapping."""
    users = df.select("user_id").distinct().join(user_map, "user_id", "left_anti")
    items = df.select("item_id").distinct().join(item_map, "item_id", "left_anti")
    return users.agg(F.count(F.lit(1)).alias("n")).select(F.lit("user").alias("kind"), "n").unionByName(
        items.agg(F.count(F.lit(1)).alias("n")).select(F.lit("item").alias("kind"), "n")
    )


def attach_item_meta(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Category, brand and price of each item; items without metadata keep nulls."""
    return df.join(meta.select("item_id", "category_code", "brand", "price"), "item_id", "left")


def attach_aliases(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Readable alias of user and item."""
    return df.join(items.select("item_id", "item_alias"), "item_id", "left").join(
        users.select("user_id", "user_alias"), "user_id", "left"
    )
