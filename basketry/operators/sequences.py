"""Item sequences per user for sequential models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import with_behavior_id
from basketry.operators.distributed import keyed_position, top_rows
from basketry.runtime import require_positive


def user_sequences(df: DataFrame, chunk: int = 10_000, tie: str = "event_id") -> DataFrame:
    """Items of each user in time order: ``(user_id, chunk, items)`` with at most ``chunk`` items per row.

    Nearly every user has one row. Longer histories go on in further rows, so none has to fit one row or one task.
    """
    require_positive(chunk=chunk)
    placed = keyed_position(
        df.select("user_id", "event_time", tie, "item_id"),
        ["user_id"], ["event_time", tie], F.date_trunc("hour", F.col("event_time")), "_position",
    )
    return (
        placed.withColumn("chunk", F.floor(F.col("_position") / chunk))
        .groupBy("user_id", "chunk")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_position", "item_id"))), lambda x: x["item_id"]).alias("items"))
    )


def _padded(array: Column, n: int, pad: int) -> Column:
    return F.slice(F.concat(array, F.array_repeat(F.lit(pad).cast("long"), n)), 1, n)


def pad_sequences(df: DataFrame, items: DataFrame, n: int = 50, pad: int = 0, tie: str = "event_id") -> DataFrame:
    """Last ``n`` known items of each user as indices, filled up at the end: ``(user_id, length, sequence)``.

    ``items`` maps ``item_id`` to ``item_idx``; other items are dropped. Only n events per user leave the map side.
    """
    require_positive(n=n)
    known = df.select("user_id", "event_time", tie, "item_id").join(items, "item_id")
    last = top_rows(known, ["user_id"], [F.desc("event_time"), F.desc(tie)], n, "_back")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col("item_idx").cast("long").alias("i"))))
    return last.groupBy("user_id").agg(ordered.alias("_o")).select(
        "user_id",
        F.size("_o").alias("length"),
        _padded(F.transform("_o", lambda x: x["i"]), n, pad).alias("sequence"),
    )


def behavior_sequences(df: DataFrame, items: DataFrame, n: int = 50, pad: int = 0, tie: str = "event_id") -> DataFrame:
    """The same with a parallel array of behaviour codes; other event types are dropped."""
    require_positive(n=n)
    known = with_behavior_id(df).select("user_id", "event_time", tie, "item_id", "behavior_id").join(items, "item_id")
    last = top_rows(known, ["user_id"], [F.desc("event_time"), F.desc(tie)], n, "_back")
    row = F.struct((-F.col("_back")).alias("o"), F.col("item_idx").cast("long").alias("i"), F.col("behavior_id").cast("long").alias("b"))
    return last.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("_o")).select(
        "user_id",
        F.size("_o").alias("length"),
        _padded(F.transform("_o", lambda x: x["i"]), n, pad).alias("sequence"),
        _padded(F.transform("_o", lambda x: x["b"]), n, pad).alias("behaviors"),
    )


def _draw(seed: int, *parts: Column) -> Column:
    """Pseudo-random number in [0, 1) that depends only on the seed and the row: the first 40 bits of an md5, which SQL engines share."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") / float(1 << 40)


def augment_sequences(df: DataFrame, kind: str, ratio: float, n_items: int, seed: int = 42, pad: int = 0) -> DataFrame:
    """A varied copy of each padded sequence: ``crop``, ``mask``, ``reorder``, or ``random`` (one of them per user).

    Crop keeps a run of items, mask replaces items at random, reorder shuffles a run. Short sequences stay as they are.
    The choice is a hash of seed and user, so it does not depend on partitions. ``n_items`` is one more than the largest item
    number, so that mask draws known items.
    """
    if kind not in ("crop", "mask", "reorder", "random"):
        raise ValueError(f"unknown augmentation {kind}")
    # Bound to columns first: expressions inside array functions then read plain values.
    rows = df.withColumns(
        {
            "_user": F.col("user_id").cast("string"),
            "_n": F.size("sequence"),
            "_items": F.slice("sequence", 1, F.col("length")),
            "_keep": F.greatest(F.lit(1), F.floor(F.col("length") * F.lit(1 - ratio)).cast("int")),
            "_span": F.greatest(F.lit(2), F.floor(F.col("length") * F.lit(ratio)).cast("int")),
        }
    ).withColumns(
        {
            "_crop_at": F.floor(_draw(seed, F.col("_user"), F.lit("crop")) * (F.col("length") - F.col("_keep") + 1)).cast("int"),
            "_span_at": F.floor(_draw(seed, F.col("_user"), F.lit("span")) * (F.col("length") - F.col("_span") + 1)).cast("int"),
        }
    )
    cropped = F.when(F.col("length") <= 1, F.col("_items")).otherwise(F.slice("_items", F.col("_crop_at") + 1, F.col("_keep")))
    masked = F.transform(
        "_items",
        lambda x, i: F.when(
            _draw(seed, F.col("_user"), i, F.lit("mask")) < ratio,
            1 + F.floor(_draw(seed, F.col("_user"), i, F.lit("item")) * max(1, n_items - 1)),
        ).otherwise(x),
    )
    run = F.slice("_items", F.col("_span_at") + 1, F.col("_span"))
    mixed = F.transform(
        F.array_sort(F.transform(run, lambda x, i: F.struct(_draw(seed, F.col("_user"), i, F.lit("order")).alias("o"), i.alias("i"), x.alias("x")))),
        lambda s: s["x"],
    )
    shuffled = F.concat(
        F.slice("_items", 1, F.col("_span_at")),
        mixed,
        F.slice("_items", F.col("_span_at") + F.col("_span") + 1, F.col("_n")),
    )
    reordered = F.when(F.col("length") <= 2, F.col("_items")).otherwise(shuffled)
    which = F.floor(_draw(seed, F.col("_user"), F.lit("kind")) * 3)
    chosen = {
        "crop": cropped,
        "mask": masked,
        "reorder": reordered,
        "random": F.when(which == 0, cropped).when(which == 1, masked).otherwise(reordered),
    }[kind]
    out = rows.withColumn("_new", chosen).withColumn("length", F.size("_new"))
    filler = F.array_repeat(F.lit(pad).cast("long"), F.col("_n"))
    return out.withColumn("sequence", F.slice(F.concat("_new", filler), 1, F.col("_n"))).drop(
        "_user", "_n", "_items", "_keep", "_span", "_crop_at", "_span_at", "_new"
    )
