"""What a user prefers and has done: context for explanations and profiles for recommenders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import age_in_days, category_path
from basketry.operators.behaviour import active_users
from basketry.operators.distributed import exact_quantiles, keyed_position, top_rows
from basketry.runtime import days, scalar

TYPES = ("view", "cart", "purchase")


def top_values_per_user(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent values of a column per user with their rank."""
    counts = df.filter(F.col(column).isNotNull()).groupBy("user_id", column).agg(F.count(F.lit(1)).alias("n"))
    return top_rows(counts, ["user_id"], [F.desc("n"), F.asc(column)], n)


def first_values_per_user(df: DataFrame, column: str, n: int | None = 5, tie: str = "event_id") -> DataFrame:
    """Distinct values of a column per user in order of first appearance, the first ``n`` or all."""
    firsts = (
        df.filter(F.col(column).isNotNull()).groupBy("user_id", column).agg(F.min(F.struct("event_time", tie)).alias("_first"))
    )
    # Without a limit the list is as long as the user has distinct brands, which the number of brands bounds.
    return top_rows(firsts, ["user_id"], [F.asc("_first")], n if n is not None else 2**31 - 1)


LISTS = ["top_categories", "top_brands", "carted_brands", "purchased_brands"]


def _preference_lists(df: DataFrame, brands_limit: int | None, tie: str, fallback: bool) -> DataFrame:
    """The four lists of a user in one pass over the log: each event adds its values to the lists it belongs to."""
    event_type, brand = F.col("event_type"), F.col("brand")
    category = category_path(F.col("category_code"))
    # Preferences come from views; with ``fallback`` a log without any view at all gives them by all events.
    preferred = event_type == "view"
    if fallback:
        preferred = preferred | ~scalar(df, F.coalesce(F.bool_or(event_type == "view"), F.lit(False)))
    belongs = {
        "top_categories": (preferred, category),
        "top_brands": (preferred, brand),
        "carted_brands": (event_type == "cart", brand),
        "purchased_brands": (event_type == "purchase", brand),
    }
    entries = [
        F.when(condition & value.isNotNull(), F.struct(F.lit(name).alias("list"), value.alias("value")))
        for name, (condition, value) in belongs.items()
    ]
    counts = (
        df.select("user_id", "event_time", tie, F.explode(F.array_compact(F.array(*entries))).alias("_e"))
        .groupBy("user_id", "_e.list", "_e.value")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("event_time", tie)).alias("_first"))
    )
    by_count = F.col("list").startswith("top_")
    order = [F.asc(F.when(by_count, -F.col("n"))), F.asc(F.when(~by_count, F.col("_first"))), F.asc("value")]
    # Without a limit a list is as long as the user has distinct brands, which the number of brands bounds.
    longest = 2**31 - 1 if brands_limit is None else max(3, brands_limit)
    ranked = top_rows(counts, ["user_id", "list"], order, longest).filter(~by_count | (F.col("rank") <= 3))
    return ranked.groupBy("user_id").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("rank", "value")))), lambda x: x["value"]
            ).alias(name)
            for name in LISTS
        ]
    )


def _preferences(df: DataFrame, brands_limit: int | None, recent_days: int, tie: str, fallback: bool) -> DataFrame:
    recent = F.col("event_time") >= scalar(df, F.max("event_time")) - days(recent_days)
    totals = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(recent).alias("recent14_events")
    )
    views = df.filter((F.col("event_type") == "view") & F.col("price").isNotNull())
    prices = exact_quantiles(
        views, ["user_id"], "price", {"price_median": 0.5, "price_p25": 0.25, "price_p75": 0.75}
    ).withColumn("price_iqr", F.col("price_p75") - F.col("price_p25"))
    out = totals.join(_preference_lists(df, brands_limit, tie, fallback), "user_id", "left").join(prices, "user_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(F.col(c), empty) for c in LISTS})


def user_context(df: DataFrame, recent_days: int = 14, tie: str = "event_id") -> DataFrame:
    """Per user: event counts, three favourite categories and brands, up to five carted and bought brands, prices viewed."""
    return _preferences(df, 5, recent_days, tie, fallback=True)


def user_profile(df: DataFrame, recent_days: int = 14, tie: str = "event_id") -> DataFrame:
    """The same with all carted and bought brands. Item lists and the event log are the tables below, see there.

    With one viewed price the quartiles are that price and their distance is zero, as interpolation gives.
    """
    return _preferences(df, None, recent_days, tie, fallback=False)


def choose_users(df: DataFrame, max_users: int | None = None, active_top: int | None = None) -> DataFrame:
    """Users a profile build is limited to: the first by id, and/or the most active among them."""
    users = df.select("user_id").distinct()
    if max_users is not None:
        users = users.orderBy("user_id").limit(max_users)
    if active_top is not None:
        users = active_users(df.join(users, "user_id", "left_semi"), active_top).select("user_id")
    return users


def profile_items(df: DataFrame) -> DataFrame:
    """One row per (user, item) seen: whether viewed, carted and bought. Recommenders join this long form."""
    return df.groupBy("user_id", "item_id").agg(
        *[F.bool_or(F.col("event_type") == t).alias(n) for t, n in zip(TYPES, ("viewed", "carted", "purchased"))]
    )


def profile_lists(df: DataFrame, chunk: int = 10_000, band=None) -> DataFrame:
    """Seen, carted and bought items of a user as arrays of at most ``chunk`` items, in item order.

    Almost every user has one array per kind. One with more items has several rows, so no row and no task has to hold
    an unbounded list.
    """
    items = profile_items(df)
    kinds = F.array_compact(F.array(F.lit("seen"), F.when(F.col("carted"), "carted"), F.when(F.col("purchased"), "purchased")))
    long = items.select("user_id", "item_id", F.explode(kinds).alias("kind"))
    if band is None:
        numeric = items.schema["item_id"].dataType.typeName() != "string"
        band = F.floor(F.col("item_id") / 65536) if numeric else F.substring("item_id", 1, 2)
    placed = keyed_position(long, ["user_id", "kind"], ["item_id"], band, "_position")
    return (
        placed.withColumn("chunk", F.floor(F.col("_position") / chunk))
        .groupBy("user_id", "kind", "chunk")
        .agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )


def event_history(df: DataFrame, chunk: int = 10_000, tie: str = "event_id") -> DataFrame:
    """Events of a user in time order as arrays of (item, type, whole days ago), at most ``chunk`` per row."""
    latest = scalar(df, F.max("event_time"))
    rows = df.filter(F.col("event_type").isin(*TYPES)).select(
        "user_id", "event_time", tie, "item_id", "event_type",
        age_in_days(F.col("event_time"), latest, whole=True).alias("days_ago"),
    )
    placed = keyed_position(
        rows, ["user_id"], ["event_time", tie], F.date_trunc("hour", F.col("event_time")), "_position"
    )
    event = F.struct("_position", F.struct("item_id", "event_type", "days_ago").alias("event"))
    return (
        placed.withColumn("chunk", F.floor(F.col("_position") / chunk))
        .groupBy("user_id", "chunk")
        .agg(F.transform(F.array_sort(F.collect_list(event)), lambda e: e["event"]).alias("events"))
    )
