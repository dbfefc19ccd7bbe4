"""Column functions over times, categories, brands, prices and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.runtime import scalar

# Text format of event times; weights and codes of event types; days a missing history counts as.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss z"
EQUAL_WEIGHTS = {"view": 1.0, "cart": 1.0, "purchase": 1.0}
BEHAVIOR_WEIGHTS = {"view": 1.0, "cart": 3.0, "purchase": 5.0}
BEHAVIOR_IDS = {"view": 1, "cart": 2, "purchase": 3}
NEVER_DAYS = 999.0
MICROS_PER_DAY = 86400e6


def normalize_time(col: Column, data_type: T.DataType | None = None) -> Column:
    """Time without zone in UTC. Text must have the fixed format, otherwise the job fails."""
    if isinstance(data_type, T.TimestampNTZType):
        return col
    moment = col if isinstance(data_type, T.TimestampType) else F.to_timestamp(col, TIME_FORMAT)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))


def lookup(col: Column, values: dict, default: object = None) -> Column:
    """Small fixed map as a chain of conditions, which stays inside generated code."""
    out = None
    for key, value in values.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def with_event_weight(df: DataFrame, weights: dict[str, float] | None = None, name: str = "weight") -> DataFrame:
    """Weight of each event by type; events without a positive weight are dropped."""
    weighted = lookup(F.col("event_type"), weights or EQUAL_WEIGHTS, 0.0)
    return df.withColumn(name, weighted).filter(F.col(name) > 0)


def last_days(df: DataFrame, n: int) -> DataFrame:
    """Events not older than ``n`` days before the latest one."""
    latest = scalar(df, F.max("event_time"))
    return df.filter(F.col("event_time") >= latest - F.make_dt_interval(F.lit(n)))


def unix_seconds(col: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", epoch, col) / 1e6).cast("long")


def with_behavior_id(df: DataFrame) -> DataFrame:
    """Numeric behaviour code; other event types are dropped."""
    return df.withColumn("behavior_id", lookup(F.col("event_type"), BEHAVIOR_IDS)).filter(
        F.col("behavior_id").isNotNull()
    )


def age_in_days(moment: Column, latest: Column, whole: bool = False) -> Column:
    age = F.timestamp_diff("MICROSECOND", moment, latest) / MICROS_PER_DAY
    return F.greatest(F.floor(age), F.lit(0)).cast("int") if whole else age


def with_days_ago(df: DataFrame, whole: bool = False, latest: Column | None = None) -> DataFrame:
    """Age of each event against the latest one, in days; whole days are rounded down and never negative."""
    latest = scalar(df, F.max("event_time")) if latest is None else latest
    return df.withColumn("days_ago", age_in_days(F.col("event_time"), latest, whole))


def category_path(col: Column, depth: int = 2) -> Column:
    """First ``depth`` tokens of a dotted code; null stays null."""
    return F.when(col.isNotNull(), F.array_join(F.slice(F.split(col, r"\."), 1, depth), "."))


def category_token(col: Column, position: int) -> Column:
    """One token of a dotted code (1-based), null if the code is shorter."""
    return F.get(F.split(col, r"\."), F.lit(position - 1))


def alias_parts(col: Column) -> tuple[Column, Column]:
    """Second and third token for readable aliases; a single token stands in for the second, none is ``unknown``."""
    second = F.coalesce(category_token(col, 2), category_token(col, 1))
    return F.when(F.coalesce(col, F.lit("")) == "", "unknown").otherwise(second), category_token(col, 3)


def category_levels(col: Column) -> dict[str, Column]:
    """All forms of a category code that operators use."""
    second, third = alias_parts(col)
    return {
        "l1": category_token(col, 1),
        "category_l2": category_path(col, 2),
        "cat_l2": category_token(col, 2),
        "alias_l2": second,
        "alias_l3": third,
    }


def brand_slug(col: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens, or ``unknown``."""
    slug = F.btrim(F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.coalesce(slug, F.lit("")) == "", "unknown").otherwise(slug)


def price_bucket(col: Column) -> Column:
    """``low`` below 30, ``mid`` up to 80, ``high`` above; a missing price is ``mid``."""
    return F.when(col.isNull() | F.isnan(col), "mid").when(col < 30, "low").when(col <= 80, "mid").otherwise("high")


def remap_brand(col: Column, mapping: dict[str, str]) -> Column:
    """Replace brands found (in lower case) in the map, keep all others."""
    replaced = lookup(F.lower(col), mapping) if mapping else F.lit(None).cast("string")
    return F.coalesce(replaced, col)


def rare_to_unk(df: DataFrame, column: str, min_freq: int = 10, name: str | None = None) -> DataFrame:
    """Replace values seen fewer than ``min_freq`` times by ``UNK``; nulls stay null."""
    rare = (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") < min_freq) & F.col(column).isNotNull())
        .select(F.col(column).alias("_rare"))
    )
    joined = df.join(rare, df[column] == F.col("_rare"), "left")
    mapped = F.when(F.col("_rare").isNotNull(), "UNK").otherwise(F.col(column))
    return joined.withColumn(name or f"{column}_mapped", mapped).drop("_rare")


def bucketize(col: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """Label of the bin a value falls in; bins are closed on the right or on the left, outside is null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (col > low) & (col <= high) if right else (col >= low) & (col < high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def half_up(col: Column, places: int) -> Column:
    """A double to ``places`` digits as SQL engines round it: scaled, taken to the next whole number, halves away from zero.

    Spark's own ``round`` looks at the shortest decimal text of the number, which may say a half where the scaled number is just below.
    """
    scale = F.lit(10.0**places)
    return F.round(col * scale) / scale


def price_fit(price: Column, median: Column, iqr: Column) -> tuple[Column, Column]:
    """Whether a price lies within 1.5 interquartile ranges of the median, and its relative distance to it."""
    half_width = 1.5 * iqr
    inside = F.coalesce((price >= median - half_width) & (price <= median + half_width), F.lit(False))
    return inside, F.abs(price - median) / F.greatest(F.abs(median), F.lit(1.0))


def log1p_counts(columns: Sequence[str]) -> list[Column]:
    return [F.log1p(F.col(c)).alias(f"{c}_log1p") for c in columns]


def ratio(part: Column, whole: Column) -> Column:
    """Part over whole, where a whole below one counts as one."""
    return part / F.greatest(whole, F.lit(1))


def repeat_ratio(distinct: Column, total: Column) -> Column:
    return 1 - distinct / total


def with_calendar(df: DataFrame) -> DataFrame:
    """Date, hour, weekday number (Monday is 0) and weekday name."""
    return df.withColumns(
        {
            "date": F.to_date("event_time"),
            "hour": F.hour("event_time"),
            "dow": F.weekday("event_time"),
            "weekday": F.date_format("event_time", "EEEE"),
        }
    )


def fill_history_nulls(df: DataFrame) -> DataFrame:
    """Neutral values for a pair without history; columns of models keep their nulls."""
    fill = {**dict.fromkeys(("ui_total_events", "ui_view", "ui_cart", "ui_purchase", "label"), 0), "ui_days_since_last": NEVER_DAYS}
    return df.fillna({name: value for name, value in fill.items() if name in df.columns})


def fill_candidate_nulls(df: DataFrame, top_k: int) -> DataFrame:
    """Neutral values for a candidate that a model does not know: a rank behind its list, and nothing else."""
    fill: dict[str, float | int] = {}
    for name in df.columns:
        if name.endswith("_norm_score"):
            fill[name] = 0.0
        elif name.endswith("_rank"):
            fill[name] = top_k + 10
        elif name.endswith("_in_top10"):
            fill[name] = 0
    return df.fillna(fill)


NOT_FEATURES = {
    "user_id", "item_id", "label", "is_eval_user",
    "user_top_brand", "item_brand", "user_top_category", "item_category",
}


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither ids nor labels."""
    return [
        f.name
        for f in df.schema.fields
        if f.name not in NOT_FEATURES and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def apply_temperature(col: Column, temperature: float | Column) -> Column:
    """Confidence after dividing its log-odds by the temperature."""
    p = F.least(F.greatest(col, F.lit(1e-7)), F.lit(1 - 1e-7))
    return 1 / (1 + F.exp(-F.ln(p / (1 - p)) / temperature))
