"""Shards by jump consistent hashing, in DataFrame functions only.

A row's key and the number of shards decide its shard; no ring table is kept. When a shard is added, a row either stays or
moves into the new shard, so 1/(n+1) of the rows move.

The key is the first 64 bits of the md5 of ``key`` as text. Spark raises an error on overflow, so the generator's 64-bit
product is built from 16- and 32-bit parts.

Defined results: a null key counts as the text ``''``; a null text has no bytes and the checksum 0; rows equal in key,
size and checksum get neighbouring slots; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The multiplier of the generator in the published algorithm, in two halves.
FACTOR_HIGH, FACTOR_LOW = divmod(2862933555777941757, 1 << 32)
MASK = (1 << 32) - 1
# So many steps are always made; about ln(shards) are needed. Rows that need more, if any, make as many as they need.
STEPS = 48
# Slots are counted in this many ranges of the key, so that no shard's rows meet in one task.
BANDS = 1024


def key_halves(key: Column) -> tuple[Column, Column]:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    part = lambda first: F.conv(F.substring(digest, first, 8), 16, 10).cast("long")
    return part(1), part(9)


def _next_key(high: Column, low: Column) -> tuple[Column, Column]:
    """(key * factor + 1) modulo 2**64, as halves."""
    low_0, low_1 = low.bitwiseAND(0xFFFF), F.shiftright(low, 16)
    high_0, high_1 = high.bitwiseAND(0xFFFF), F.shiftright(high, 16)
    upper = low_1 * FACTOR_LOW
    whole = low_0 * FACTOR_LOW + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + 1
    crossed = high_0 * FACTOR_LOW + F.shiftleft((high_1 * FACTOR_LOW).bitwiseAND(0xFFFF), 16)
    raised = F.shiftright(whole, 32) + F.shiftright(upper, 16) + (low * FACTOR_HIGH).bitwiseAND(MASK) + crossed.bitwiseAND(MASK)
    return raised.bitwiseAND(MASK), whole.bitwiseAND(MASK)


def jump_shard(high: Column, low: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of the 64-bit key ``high * 2**32 + low``."""
    if shards < 1:
        raise ValueError(f"shards must be positive, got {shards}")

    def step(state: Column, _: Column) -> Column:
        high, low = _next_key(state["high"], state["low"])
        target = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(state["next"].alias("shard"), target.alias("next"), high.alias("high"), low.alias("low"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"), high.alias("high"), low.alias("low"))
    most = F.aggregate(F.sequence(F.lit(1), F.lit(min(STEPS, shards))), start, step)
    if shards <= STEPS:
        return F.coalesce(most["shard"].cast("int"), F.lit(0))
    rest = lambda state: F.when(state["next"] < shards, F.sequence(F.lit(1), F.lit(shards))).otherwise(F.array().cast("array<int>"))
    # transform() over one element gives the first result a name, so that it isn't computed twice.
    return F.transform(F.array(most), lambda state: F.aggregate(rest(state), state, step))[0]["shard"].cast("int")


def consistent_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16, bands: int = BANDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row.

    ``size`` is the text's UTF-8 length plus ``overhead``; ``slot`` counts the rows of a shard without gaps from 0, in the
    order of the hashed key; ``grown_shard`` is the shard when there is one more. Rows that are equal in all of this are
    counted before the shuffle, and one task counts one range of keys of one shard.
    """
    high, low = key_halves(F.col(key))
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = (
        df.select(
            F.col(key).alias("_key"), high.alias("_high"), low.alias("_low"),
            (F.octet_length(text_bytes) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text_bytes).alias("text_crc32"),
        )
        .withColumns({"shard": jump_shard(F.col("_high"), F.col("_low"), shards), "grown_shard": jump_shard(F.col("_high"), F.col("_low"), shards + 1)})
        .withColumn("_band", F.coalesce(F.floor(F.col("_high") * bands / (1 << 32)).cast("int"), F.lit(0)))
    )
    equal = rows.groupBy("shard", "_band", "_high", "_low", "_key", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("_copies"))
    return _slots(rows, equal, key)


def _slots(rows: DataFrame, equal: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy("shard", "_band").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_band", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_band").orderBy("_high", "_low", "_key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("_first", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(offsets, ["shard", "_band"])
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", "shard", "grown_shard", (F.col("_offset") + F.col("_first")).alias("_at"), slots.alias("_n")).select(
        key, "size", "text_crc32", "shard", (F.col("_at") + F.col("_n")).alias("slot"), "grown_shard"
    )
