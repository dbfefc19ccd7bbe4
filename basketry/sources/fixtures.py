"""Map the star-schema test tables to the event-log model (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.distributed import top_rows
from basketry.runtime import scalar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _category() -> Column:
    words = F.split("p_name", " ")
    return F.lower(F.concat_ws(".", F.col("p_type"), F.element_at(words, 2), F.element_at(words, 1)))


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log from ``events`` and ``part``; every thirteenth item has neither brand nor category."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", _category().alias("p_category"))
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        F.col("value").alias("price"),
    )
    known = F.col("item_id") % 13 != 0
    return events.join(part, F.col("item_id") == F.col("p_partkey"), "left").select(
        "event_id",
        "user_id",
        "item_id",
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("event_time", "yyyyMMdd")).alias("user_session"),
        "event_time",
        F.when(known, F.col("p_category")).alias("category_code"),
        F.when(known, F.col("p_brand")).alias("brand"),
        "price",
        "event_type",
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger and sparser event log from ``lineitem``, ``orders`` and ``part``."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", _category().alias("p_category"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice", "l_quantity"
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_orderkey").cast("string").alias("user_session"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("event_time"),
            F.col("p_category").alias("category_code"),
            F.col("p_brand").alias("brand"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.when(F.col("l_returnflag") == "N", "view")
            .when(F.col("l_returnflag") == "A", "cart")
            .otherwise("purchase")
            .alias("event_type"),
        )
    )


def shopping(log: DataFrame) -> DataFrame:
    """The events the models know: views, carts and purchases."""
    return log.filter(F.col("event_type").isin("view", "cart", "purchase"))


def model_predictions(train: DataFrame, n: int = 50) -> DataFrame:
    """Three simple scorers over the training log, each ranked to its best ``n`` items per user."""
    last = scalar(train, F.max("event_time"))
    pairs = shopping(train).groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("_count"), F.sum("price").alias("_spend"), F.max("event_time").alias("_last")
    )
    age = F.round(F.timestamp_diff("MICROSECOND", F.col("_last"), last) / 86400e6, 6)
    scores = F.array(
        F.struct(F.lit("freq").alias("model"), F.col("_count").cast("double").alias("score")),
        F.struct(F.lit("recency").alias("model"), (-age).alias("score")),
        F.struct(F.lit("spend").alias("model"), F.round("_spend", 6).alias("score")),
    )
    long = pairs.select("user_id", "item_id", F.explode(scores).alias("_s")).select(
        "_s.model", "user_id", "item_id", "_s.score"
    )
    return top_rows(long, ["model", "user_id"], [F.desc("score"), F.asc("item_id")], n)
