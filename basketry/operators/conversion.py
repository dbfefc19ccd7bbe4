"""Conversion from view to cart to purchase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import category_token
from basketry.operators.behaviour import QUARTILES, describe
from basketry.operators.distributed import exact_quantiles, most_frequent, running_before
from basketry.runtime import count_of, scalar

PAIR = ["user_id", "item_id"]


TRANSITIONS = (("view", "cart"), ("view", "purchase"), ("cart", "purchase"))


def temporal_pairs(df: DataFrame, transitions: Sequence[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """For each (a, b): event pairs of the same user and item with b strictly later, against the number of a events.

    Pairs are counted, not built: each b event adds the number of earlier a events, taken from running counts. One
    pass over the log serves all transitions.
    """
    types = sorted({t for pair in transitions for t in pair})
    moments = (
        df.filter(F.col("event_type").isin(types))
        .groupBy(*PAIR, "event_time")
        .agg(*[count_of(t).alias(f"_n_{t}") for t in types])
    )
    for t in sorted({a for a, _ in transitions}):
        moments = running_before(moments, PAIR, "event_time", F.to_date("event_time"), F.col(f"_n_{t}"), f"_before_{t}")
    sums = []
    for i, (a, b) in enumerate(transitions):
        sums.append(F.coalesce(F.sum(F.col(f"_n_{b}") * F.col(f"_before_{a}")), F.lit(0)).alias(f"p{i}"))
        sums.append(F.coalesce(F.sum(f"_n_{a}"), F.lit(0)).alias(f"f{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("from_type"), F.lit(b).alias("to_type"), F.col(f"p{i}").alias("n_pairs"), F.col(f"f{i}").alias("n_from")
            )
            for i, (a, b) in enumerate(transitions)
        ]
    )
    rate = F.coalesce(F.col("n_pairs") / F.nullif(F.col("n_from"), F.lit(0)) * 100, F.lit(0.0))
    return moments.agg(*sums).select(F.inline(rows)).withColumn("rate_pct", rate)


def cart_before_purchase(df: DataFrame) -> DataFrame:
    """Each distinct purchase (user, item, time) with whether the user had carted the item strictly earlier.

    The earliest cart of a pair decides, so one value per pair is joined instead of all its carts.
    """
    purchases = df.filter(F.col("event_type") == "purchase").select(*PAIR, "event_time").distinct()
    carts = df.filter(F.col("event_type") == "cart").groupBy(*PAIR).agg(F.min("event_time").alias("_cart"))
    before = F.coalesce(F.col("_cart") < F.col("event_time"), F.lit(False))
    return purchases.join(carts, PAIR, "left").withColumn("cart_before", before).drop("_cart")


def cart_bypass(df: DataFrame, start: str) -> DataFrame:
    """Purchases via cart and direct ones, before and from ``start`` on, and in all."""
    marked = cart_before_purchase(df)
    during = F.col("event_time") >= F.lit(start).cast("timestamp_ntz")
    labelled = marked.select("cart_before", F.explode(F.array(F.lit("all"), F.when(during, "during").otherwise("before"))).alias("period"))
    return _bypass_rates(labelled, "period")


def cart_bypass_daily(df: DataFrame) -> DataFrame:
    """The same per date."""
    return _bypass_rates(cart_before_purchase(df).withColumn("date", F.to_date("event_time")), "date")


def _bypass_rates(marked: DataFrame, key: str) -> DataFrame:
    counts = marked.groupBy(key).agg(F.count(F.lit(1)).alias("n_purchases"), F.count_if("cart_before").alias("via_cart"))
    rate = F.col("via_cart") / F.col("n_purchases")
    return counts.select(
        "*",
        rate.alias("via_cart_rate"),
        (F.col("n_purchases") - F.col("via_cart")).alias("direct"),
        (1 - rate).alias("direct_rate"),
    )


def first_view_to_purchase(df: DataFrame) -> DataFrame:
    """Each purchase with the minutes since the user first viewed the item, null if never viewed."""
    views = df.filter(F.col("event_type") == "view").groupBy(*PAIR).agg(F.min("event_time").alias("first_view"))
    purchases = df.filter(F.col("event_type") == "purchase").select(*PAIR, F.col("event_time").alias("purchase_time"))
    minutes = F.timestamp_diff("MICROSECOND", F.col("first_view"), F.col("purchase_time")) / 60e6
    return purchases.join(views, PAIR, "left").withColumn("minutes", minutes)


def purchase_lag(df: DataFrame, start: str) -> DataFrame:
    """Distribution of these minutes for purchases before and from ``start`` on."""
    during = F.col("purchase_time") >= F.lit(start).cast("timestamp_ntz")
    lagged = first_view_to_purchase(df).withColumn("period", F.when(during, "during").otherwise("before"))
    rows = lagged.groupBy("period").agg(F.count(F.lit(1)).alias("n_purchases"))
    return rows.join(describe(lagged, "minutes", QUARTILES, ["period"]).select("period", "mean", *QUARTILES), "period", "left")


def new_user_rate(df: DataFrame) -> DataFrame:
    """Per date: purchases, and those by users whose first event was on that date.

    Events are first counted per user and date; the first date of a user is then found on that small table.
    """
    daily = df.groupBy("user_id", F.to_date("event_time").alias("date")).agg(count_of("purchase").alias("n"))
    first = daily.groupBy("user_id").agg(F.min("date").alias("_first"))
    counts = daily.filter(F.col("n") > 0).join(first, "user_id").groupBy("date").agg(
        F.sum("n").alias("n_purch"),
        F.sum(F.when(F.col("date") == F.col("_first"), F.col("n")).otherwise(0)).alias("n_new_user"),
    )
    return counts.withColumn("new_user_rate", F.col("n_new_user") / F.col("n_purch"))


def funnel_pairs(df: DataFrame) -> DataFrame:
    """(user, item) pairs by the order of their first view, cart and purchase."""

    def first(event_type: str):
        return F.min(F.when(F.col("event_type") == event_type, F.col("event_time"))).alias(event_type)

    pairs = df.groupBy(*PAIR).agg(first("view"), first("cart"), first("purchase"))
    return pairs.agg(
        F.count("view").alias("view_pairs"),
        F.count_if(F.col("cart") > F.col("view")).alias("view_to_cart"),
        F.count_if(F.col("purchase") > F.col("view")).alias("view_to_purchase"),
        F.count("cart").alias("cart_pairs"),
        F.count_if(F.col("purchase") > F.col("cart")).alias("cart_to_purchase"),
    )


def item_conversion_meta(df: DataFrame) -> DataFrame:
    """Per item: median price, most frequent category and brand, counts by type, whether ever viewed or carted."""
    tokens = df.withColumn("cat_l2", category_token(F.col("category_code"), 2))
    counts = df.groupBy("item_id").agg(
        count_of("view").alias("n_view"), count_of("cart").alias("n_cart"), count_of("purchase").alias("n_purchase")
    )
    return (
        counts.join(exact_quantiles(df, ["item_id"], "price", {"price_med": 0.5}), "item_id", "left")
        .join(most_frequent(tokens, ["item_id"], ["cat_l2", "brand"]), "item_id", "left")
        .withColumn("ever_cart", F.col("n_cart") > 0)
        .withColumn("ever_view", F.col("n_view") > 0)
    )


def cart_experience(meta: DataFrame) -> DataFrame:
    """Items that were ever carted against items that were only viewed: number, median price, median views."""
    group = F.when(F.col("ever_cart"), "carted").when(F.col("ever_view"), "view only")
    items = meta.withColumn("kind", group).filter(F.col("kind").isNotNull())
    counts = items.groupBy("kind").agg(F.count(F.lit(1)).alias("n_items"))
    return counts.join(exact_quantiles(items, ["kind"], "price_med", {"median_price": 0.5}), "kind", "left").join(
        exact_quantiles(items, ["kind"], "n_view", {"median_views": 0.5}), "kind", "left"
    )


def category_cart_rate(df: DataFrame, min_views: int = 100) -> DataFrame:
    """Of items with enough views: number, share ever carted and median price per category."""
    items = item_conversion_meta(df).filter((F.col("n_view") >= min_views) & F.col("cat_l2").isNotNull())
    rates = items.groupBy("cat_l2").agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(F.col("ever_cart").cast("double")).alias("cart_rate")
    )
    return rates.join(exact_quantiles(items, ["cat_l2"], "price_med", {"price_med": 0.5}), "cat_l2", "left")


def prior_history_share(df: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Buyers of a period: how many had a view before it, and how many had no earlier event at all."""
    time = F.col("event_time")
    earlier = time < F.lit(start).cast("timestamp_ntz")
    inside = ~earlier if end is None else ~earlier & (time < F.lit(end).cast("timestamp_ntz"))
    users = df.groupBy("user_id").agg(
        F.bool_or(inside & (F.col("event_type") == "purchase")).alias("buyer"),
        F.bool_or(earlier & (F.col("event_type") == "view")).alias("viewed"),
        F.bool_or(earlier).alias("known"),
    )
    return users.filter("buyer").agg(
        F.count(F.lit(1)).alias("n_buyers"),
        F.count_if("viewed").alias("with_view"),
        F.count_if(~F.col("known")).alias("without_history"),
    )


def session_crossing(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """(user, item) pairs with view and purchase: first view and first purchase in the same session or not."""

    def first(event_type: str):
        order = F.when(F.col("event_type") == event_type, F.struct("event_time", tie, "user_session"))
        return F.min(order)["user_session"].alias(event_type)

    pairs = df.groupBy(*PAIR).agg(first("view"), first("purchase")).dropna(subset=["view", "purchase"])
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("view") == F.col("purchase")).alias("same_session")
    ).select(
        "*",
        (F.col("n_pairs") - F.col("same_session")).alias("other_session"),
        (F.col("same_session") / F.nullif(F.col("n_pairs"), F.lit(0))).alias("same_share"),
    )


def overall_rate(df: DataFrame, event_type: str):
    """Share of an event type among all events, as a scalar of the plan."""
    return scalar(df, count_of(event_type) / F.count(F.lit(1)))
