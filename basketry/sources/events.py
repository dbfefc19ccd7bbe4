"""Readers for event logs, ranked lists and target users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.scalars import normalize_time
from basketry.operators.distributed import sorted_index, top_rows
from basketry.runtime import require_columns, require_positive, scalar


def read_events(spark: SparkSession, path: str, parse_time: bool = True) -> DataFrame:
    """Event log from parquet. String times become UTC timestamps without zone unless ``parse_time`` is off."""
    df = spark.read.parquet(path)
    if parse_time and "event_time" in df.columns:
        df = df.withColumn("event_time", normalize_time(F.col("event_time"), df.schema["event_time"].dataType))
    return df


def read_events_for(
    spark: SparkSession,
    path: str,
    users: DataFrame | list | None = None,
    items: DataFrame | list | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Events of some users and/or items. Short lists become pushed-down filters, tables become semi joins."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    for name, wanted in (("user_id", users), ("item_id", items)):
        if wanted is None:
            continue
        if isinstance(wanted, DataFrame):
            df = df.join(wanted.select(name), name, "left_semi")
        else:
            df = df.filter(F.col(name).isin(list(wanted)))
    return df


def max_event_time(df: DataFrame) -> DataFrame:
    """Largest event time as a one-row table."""
    return df.agg(F.max("event_time").alias("max_event_time"))


def target_users(df: DataFrame) -> DataFrame:
    """The users an output must cover."""
    return df.select("user_id").distinct()


def read_topk_csv(spark: SparkSession, path: str, top_k: int = 10) -> DataFrame:
    """First ``top_k`` rows per user of a long CSV; the order of rows in the file is the rank."""
    require_positive(top_k=top_k)
    header = spark.read.option("header", True).csv(path)
    require_columns(header, "user_id", "item_id")
    # Splits of a file may be read in any order, so a line is placed by file, split and place within the split.
    lines = header.select(
        "user_id",
        "item_id",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    order = [F.asc("_file"), F.asc("_block"), F.asc("_line")]
    return top_rows(lines, ["user_id"], order, top_k).drop("_file", "_block", "_line")


def dense_index(df: DataFrame, column: str, index: str | None = None) -> DataFrame:
    """Sorted distinct ids with their 0-based index."""
    return sorted_index(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column], index or f"{column}_idx")


def last_event_time(df: DataFrame):
    """The largest event time as a scalar column of the plan."""
    return scalar(df, F.max("event_time"))
