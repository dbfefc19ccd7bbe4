"""Building blocks that keep working when one key holds a large share of the rows.

A window or a list per key puts the whole key in one task. The functions here first cut a key into ordered bands
(by hour, by value range, by sorted partition), do the per-row work inside a band, and carry only one small row per
band across the key. Results are exact. Keys and bands must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.runtime import cut, unused


def _known(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows without null in the given columns.

    A join drops such rows on both of its sides, but the optimizer cannot push that as far down on one side as on the
    other. Saying it up front keeps both sides the same plan, so that their common shuffle is run once and reused.
    """
    kept = F.lit(True)
    for name in names:
        kept = kept & F.col(name).isNotNull()
    return df.filter(kept)


def keyed_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    band: Column,
    position: str = "position",
    size: str | None = None,
) -> DataFrame:
    """0-based position of each row inside its key, and optionally the number of rows of the key.

    ``band`` must not decrease along ``order``. Only (key, band) groups are sorted, so a hot key is spread over as many
    tasks as it has bands.
    """
    keys = list(keys)
    banded = _known(df.withColumn("_band", band), [*keys, "_band"])
    per_band = banded.groupBy(*keys, "_band").agg(F.count(F.lit(1)).alias("_rows"))
    along = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = per_band.select(
        *keys,
        "_band",
        (F.sum("_rows").over(along) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("_size"),
    )
    joined = banded.join(offsets, [*keys, "_band"])
    inside = W.partitionBy(*keys, "_band").orderBy(*order)
    out = joined.withColumn(position, F.col("_before") + F.row_number().over(inside) - 1)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_band", "_before", "_size")


def running_before(
    df: DataFrame, keys: Sequence[str], order: str, band: Column, value: Column, name: str = "before"
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key; ``order`` is unique inside a key."""
    keys = list(keys)
    banded = _known(df.withColumn("_band", band).withColumn("_value", value), [*keys, "_band"])
    totals = banded.groupBy(*keys, "_band").agg(F.sum("_value").alias("_sum"))
    along = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = totals.select(*keys, "_band", (F.sum("_sum").over(along) - F.col("_sum")).alias("_earlier"))
    inside = W.partitionBy(*keys, "_band").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        banded.join(earlier, [*keys, "_band"])
        .withColumn(name, F.col("_earlier") + F.sum("_value").over(inside) - F.col("_value"))
        .drop("_band", "_value", "_earlier")
    )


def gaps_to_previous(
    df: DataFrame, keys: Sequence[str], start: str, end: str, band: Column, gap: str = "gap_us"
) -> DataFrame:
    """Microseconds from the end of the previous row of the key to the start of this one; first rows are left out.

    Rows are ordered by ``start``. Inside a band the previous row is a plain ``lag``; the first row of a band takes
    its predecessor from the last row of the band before.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), band.alias("_band"))
    inside = W.partitionBy(*keys, "_band").orderBy("_start", "_end")
    within = rows.select(*keys, "_start", F.lag("_end").over(inside).alias("_previous")).filter(
        F.col("_previous").isNotNull()
    )
    edges = rows.groupBy(*keys, "_band").agg(
        F.min("_start").alias("_start"),
        F.max(F.struct("_start", "_end"))["_end"].alias("_last"),
    )
    across = edges.select(
        *keys, "_start", F.lag("_last").over(W.partitionBy(*keys).orderBy("_band")).alias("_previous")
    ).filter(F.col("_previous").isNotNull())
    return within.unionByName(across).select(
        *keys, F.timestamp_diff("MICROSECOND", F.col("_previous"), F.col("_start")).alias(gap)
    )


def _value_band(value: Column) -> Column:
    """Order-preserving code of a double: 16,384 steps per power of two on both sides of zero, so that close values differ."""
    v = value.cast("double")
    magnitude = (F.floor(F.log2(F.abs(v)) * 16384) + 20_000_000).cast("long")
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, magnitude).otherwise(-magnitude)


def _between(low: Column, high: Column, share: Column) -> Column:
    """``low * (1 - share) + high * share`` with the first product unrounded, as SQL engines interpolate quantiles.

    The product is split into its rounded value and the exact rest (Dekker), and so is the sum (Knuth).
    """

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * F.lit(134217729.0)
        top = wide - (wide - x)
        return top, x - top

    rest = 1 - share
    product, other = low * rest, high * share
    (a, b), (c, d) = halves(low), halves(rest)
    lost = ((a * c - product) + a * d + b * c) + b * d
    total = product + other
    back = total - product
    missed = (product - (total - back)) + (other - back)
    tame = F.abs(low) < 1e290
    return F.when(share == 0, low).when(tame, total + (missed + lost)).otherwise(total)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probabilities: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key (one row in all without keys).

    Values are counted first (combined on the map side), then located by running counts over value bands and inside
    one band. No task ever holds all the values of a key.
    """
    keys = list(keys)
    column = F.col(value) if isinstance(value, str) else value
    counted = (
        df.select(*keys, column.cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_band", _value_band(F.col("_v")))
    )
    counted = _known(counted, [*keys, "_band"])
    along = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, W.currentRow)
    bands = (
        counted.groupBy(*keys, "_band")
        .agg(F.sum("_n").alias("_band_n"))
        .select(
            *keys,
            "_band",
            (F.sum("_band_n").over(along) - F.col("_band_n")).alias("_before"),
            F.sum("_band_n").over(W.partitionBy(*keys)).alias("_total"),
        )
    )
    inside = W.partitionBy(*keys, "_band").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counted.join(bands, [*keys, "_band"]).withColumn(
        "_to", F.col("_before") + F.sum("_n").over(inside)
    )
    aggregates = []
    for name, p in probabilities.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for side, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_to") > position) & (F.col("_to") - F.col("_n") <= position)
            aggregates.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
    aggregates.append(F.max("_total").alias("_total"))
    found = placed.groupBy(*keys).agg(*aggregates)
    out = []
    for name, p in probabilities.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(_between(low, high, at - F.floor(at)).alias(name))
    return found.select(*keys, *out)


def most_frequent(df: DataFrame, keys: Sequence[str], values: Sequence[str], times: Column | None = None) -> DataFrame:
    """Most frequent non-null value per key for each column; ties go to the smallest value.

    A row counts once, or ``times`` times. All columns are counted in one pass, and counts are combined before anything is grouped by key alone.
    """
    keys, values = list(keys), list(values)
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("which"), F.col(v).cast("string").alias("value")) for v in values]))
    counted = (
        df.select(*keys, pairs.alias("_p"), (F.lit(1) if times is None else times).alias("_times"))
        .select(*keys, "_p.which", "_p.value", "_times")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "which", "value")
        .agg(F.sum("_times").alias("_n"))
    )
    best = F.struct((-F.col("_n")).alias("n"), F.col("value").alias("value"))
    return counted.groupBy(*keys).agg(
        *[F.min(F.when(F.col("which") == v, best))["value"].alias(v) for v in values]
    )


def sorted_index(df: DataFrame, order: Sequence[str | Column], index: str = "index") -> DataFrame:
    """0-based position of each row in the total order, without putting all rows in one task.

    Rows are range-partitioned and sorted; a row's index is the number of rows in earlier partitions plus its place in
    its own. The sorted rows are checkpointed once, so both reads see the same partitions.
    """
    names = df.columns
    number, own, earlier, count = (unused(df, n) for n in ("_id", "_p", "_before", "_rows"))
    numbered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()))
    part = F.shiftright(number, 33)
    sizes = numbered.groupBy(part.alias(own)).agg(F.count(F.lit(1)).alias(count))
    # One row per partition of the sorted table, so this window is bounded by the number of tasks.
    before = W.orderBy(own).rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select(own, (F.sum(count).over(before) - F.col(count)).alias(earlier))
    place = F.col(number).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(offsets), part == F.col(own)).select(*names, (F.col(earlier) + place).alias(index))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their 1-based rank.

    With the settings of ``runtime.tuned`` Spark limits each map task to n rows per key before it shuffles, for any n.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
