"""Feature tables per item, per user, per pair, and per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import (
    age_in_days,
    category_path,
    fill_candidate_nulls,
    fill_history_nulls,
    log1p_counts,
    ratio,
    repeat_ratio,
    with_event_weight,
)
from basketry.operators.distributed import exact_quantiles, most_frequent
from basketry.operators.lookups import broadcast_if_small
from basketry.runtime import count_of, cut, days, scalar, union_all


def _latest(df: DataFrame) -> Column:
    return scalar(df, F.max("event_time"))


GRAIN = ["user_id", "item_id", "brand", "category_code"]
KINDS = ("view", "cart", "purchase")


def event_grain(df: DataFrame) -> DataFrame:
    """The log counted by user, item, brand and category: what the features below are rolled up from.

    Counts are combined before the shuffle; no user or item has more rows than it has partners.
    """
    return df.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("events"),
        count_of("view").alias("view"),
        count_of("cart").alias("cart"),
        count_of("purchase").alias("purchase"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("prices"),
    )


def _counts(prefix: str, total: str) -> list[Column]:
    return [F.sum("events").alias(total), *(F.sum(kind).alias(f"{prefix}_{kind}") for kind in KINDS)]


def item_popularity(train: DataFrame) -> DataFrame:
    """Per item: event counts, distinct users, days since first and last event, mean price and logs of the counts.

    Straight from the log, which is read once more for its latest time; partial counts keep a hot item small.
    """
    counts = [F.count(F.lit(1)).alias("item_total_events"), *(count_of(kind).alias(f"item_{kind}") for kind in KINDS)]
    return _item_popularity(train, counts, "event_time", "event_time", F.avg("price"), _latest(train))


def _item_popularity(rows: DataFrame, counts: list[Column], first: str, last: str, price: Column, latest: Column) -> DataFrame:
    found = rows.groupBy("item_id").agg(
        *counts,
        F.countDistinct("user_id").alias("item_unique_users"),
        age_in_days(F.min(first), latest).alias("item_days_since_first"),
        age_in_days(F.max(last), latest).alias("item_days_since_last"),
        price.alias("item_avg_price"),
    )
    logged = ["item_total_events", "item_view", "item_cart", "item_purchase", "item_unique_users"]
    return found.select("*", *log1p_counts(logged))


def _item_popularity_of(grain: DataFrame) -> DataFrame:
    """The same from a stored ``event_grain``."""
    price = F.sum("price_sum") / F.nullif(F.sum("prices"), F.lit(0))
    return _item_popularity(grain, _counts("item", "item_total_events"), "first_time", "last_time", price, scalar(grain, F.max("last_time")))


def user_activity(train: DataFrame) -> DataFrame:
    """Per user: event counts, distinct items, days since first and last event, ratios and logs of the counts."""
    counts = [F.count(F.lit(1)).alias("user_total_events"), *(count_of(kind).alias(f"user_{kind}") for kind in KINDS)]
    return _user_activity(train, counts, "event_time", "event_time", _latest(train))


def _user_activity_of(grain: DataFrame) -> DataFrame:
    """The same from a stored ``event_grain``."""
    return _user_activity(grain, _counts("user", "user_total_events"), "first_time", "last_time", scalar(grain, F.max("last_time")))


def _user_activity(rows: DataFrame, counts: list[Column], first: str, last: str, latest: Column) -> DataFrame:
    found = rows.groupBy("user_id").agg(
        *counts,
        F.countDistinct("item_id").alias("user_distinct_items"),
        age_in_days(F.min(first), latest).alias("user_days_since_first"),
        age_in_days(F.max(last), latest).alias("user_days_recency"),
    )
    logged = ["user_total_events", "user_distinct_items", "user_view", "user_cart", "user_purchase"]
    return found.select(
        "*",
        repeat_ratio(F.col("user_distinct_items"), F.col("user_total_events")).alias("user_repeat_ratio"),
        ratio(F.col("user_cart"), F.col("user_view")).alias("user_cart_view_ratio"),
        ratio(F.col("user_purchase"), F.col("user_view")).alias("user_purchase_view_ratio"),
        *log1p_counts(logged),
    )


def user_item_history(train: DataFrame) -> DataFrame:
    """Per (user, item): event counts and days since the last event."""
    return _user_item_history(event_grain(train))


def _user_item_history(grain: DataFrame) -> DataFrame:
    latest = scalar(grain, F.max("last_time"))
    return grain.groupBy("user_id", "item_id").agg(
        *_counts("ui", "ui_total_events"), age_in_days(F.max("last_time"), latest).alias("ui_days_since_last")
    )


def affinity_top1(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Most frequent brand and category per user, and per item."""
    return _affinity_top1(event_grain(train))


def _affinity_top1(grain: DataFrame) -> tuple[DataFrame, DataFrame]:
    users = most_frequent(grain, ["user_id"], ["brand", "category_code"], F.col("events")).select(
        "user_id", F.col("brand").alias("user_top_brand"), F.col("category_code").alias("user_top_category")
    )
    items = most_frequent(grain, ["item_id"], ["brand", "category_code"], F.col("events")).select(
        "item_id", F.col("brand").alias("item_brand"), F.col("category_code").alias("item_category")
    )
    return users, items


def interaction_matrix(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Summed event weight per (user, item), zero sums left out."""
    summed = with_event_weight(df, weights).groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight"))
    return summed.filter(F.col("weight") != 0)


def item_catalog(df: DataFrame, recent_days: int = 14) -> DataFrame:
    """Per item: most frequent category and brand, median price, event counts and first and last time."""
    recent = F.col("event_time") >= _latest(df) - days(recent_days)
    counts = df.groupBy("item_id").agg(
        F.count("event_time").alias("total_events"),
        F.count_if(recent).alias("recent14_events"),
        F.max("event_time").alias("last_seen"),
        F.min("event_time").alias("first_seen"),
    )
    return (
        counts.join(most_frequent(df, ["item_id"], ["category_code", "brand"]), "item_id", "left")
        .join(exact_quantiles(df, ["item_id"], "price", {"price": 0.5}), "item_id", "left")
        .withColumn("category_l2", category_path(F.col("category_code")))
    )


def smoothed_conversion(hits: Column, views: Column, prior: Column, alpha: float = 50.0) -> Column:
    """Conversion rate drawn towards the prior rate of all items as if ``alpha`` more views had been seen."""
    return (hits + alpha * prior) / (views + alpha)


def _prior(df: DataFrame, event_type: str) -> Column:
    return scalar(df, count_of(event_type) / F.greatest(count_of("view"), F.lit(1)))


def item_signals_base(df: DataFrame, recent_days: int = 14, alpha: float = 50.0) -> DataFrame:
    """Per item: metadata, mean price, log popularity, counts by type, smoothed conversion and view trend."""
    latest = _latest(df)
    recent = F.col("event_time") >= latest - days(recent_days)
    before = ~recent & (F.col("event_time") >= latest - days(2 * recent_days))
    view = F.col("event_type") == "view"
    with_l2 = df.withColumn("category_l2", category_path(F.col("category_code")))
    counts = df.groupBy("item_id").agg(
        F.avg("price").alias("price"),
        F.log1p(F.count(F.lit(1))).alias("item_pop_log1p"),
        F.log1p(F.count_if(recent)).alias("item_recent14_pop_log1p"),
        count_of("view").alias("item_view_count"),
        count_of("cart").alias("item_cart_count"),
        count_of("purchase").alias("item_purchase_count"),
        F.count_if(view & recent).alias("item_recent14_view_count"),
        F.count_if(view & before).alias("item_prev14_view_count"),
    )
    meta = most_frequent(with_l2, ["item_id"], ["category_code", "category_l2", "brand"])
    views = F.col("item_view_count")
    return counts.join(meta, "item_id", "left").select(
        "*",
        smoothed_conversion(F.col("item_cart_count"), views, _prior(df, "cart"), alpha).alias("item_v2c_smoothed"),
        smoothed_conversion(F.col("item_purchase_count"), views, _prior(df, "purchase"), alpha).alias(
            "item_v2p_smoothed"
        ),
        ((F.col("item_recent14_view_count") + 1) / (F.col("item_prev14_view_count") + 1)).alias(
            "item_recent_trend_ratio"
        ),
    )


def item_conversion(df: DataFrame, alpha: float = 50.0) -> DataFrame:
    """Per item: views, purchases and the smoothed view-to-purchase rate."""
    counts = df.groupBy("item_id").agg(count_of("view").alias("n_view"), count_of("purchase").alias("n_purchase"))
    rate = smoothed_conversion(F.col("n_purchase"), F.col("n_view"), _prior(df, "purchase"), alpha)
    return counts.withColumn("v2p_smoothed", rate)


def vocabularies(catalog: DataFrame, top_brands: int = 20) -> tuple[DataFrame, DataFrame]:
    """Categories by number of events, and the ``top_brands`` brands by number of events, each with its place."""

    def ranked(column: str, n: int | None) -> DataFrame:
        mass = (
            catalog.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("total_events").alias("events"))
        )
        ordered = mass.orderBy(F.desc("events"), F.asc(column))
        return ordered.limit(n) if n is not None else ordered

    return ranked("category_l2", None), ranked("brand", top_brands)


def candidate_pool(preds: DataFrame, k: int = 50) -> DataFrame:
    """Distinct (user, item) pairs among each model's first ``k``."""
    return preds.filter(F.col("rank") <= k).select("user_id", "item_id").distinct()


def attach_model_scores(preds: DataFrame, models: list[str], top_k: int = 50) -> DataFrame:
    """One row per candidate with every model's min-max score, rank and top-ten flag, and how many models agree.

    The union of the models' lists is the candidate pool, so grouping it gives pool and scores in a single shuffle.
    """
    from basketry.operators.windows import minmax_within_user

    top = minmax_within_user(preds.filter(F.col("rank") <= top_k), keys=("model", "user_id"))
    columns = []
    for model in models:
        mine = F.col("model") == model
        columns += [
            F.max(F.when(mine, F.col("norm_score"))).alias(f"{model}_norm_score"),
            F.max(F.when(mine, F.col("rank"))).alias(f"{model}_rank"),
            F.max(F.when(mine, (F.col("rank") <= 10).cast("int"))).alias(f"{model}_in_top10"),
        ]
    wide = fill_candidate_nulls(top.groupBy("user_id", "item_id").agg(*columns), top_k)
    agree = sum((F.col(f"{m}_in_top10") for m in models[1:]), F.col(f"{models[0]}_in_top10"))
    return wide.withColumn("n_models_in_top10", agree)


def attach_history(cand: DataFrame, history: DataFrame) -> DataFrame:
    """Past events of the pair; pairs without history get neutral values."""
    return fill_history_nulls(cand.join(history, ["user_id", "item_id"], "left"))


def attach_affinity(cand: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Whether the item has the user's favourite brand and category."""

    def match(a: str, b: str) -> Column:
        return F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))

    return (
        cand.join(items, "item_id", "left")
        .join(users, "user_id", "left")
        .withColumn("brand_match", match("user_top_brand", "item_brand"))
        .withColumn("category_match", match("user_top_category", "item_category"))
    )


def attach_label(cand: DataFrame, truth: DataFrame, users: DataFrame) -> DataFrame:
    """1 for pairs in the truth, and a flag for evaluable users. Truth is made distinct so no row is doubled."""
    positives = truth.select("user_id", "item_id").distinct().withColumn("label", F.lit(1))
    known = users.select("user_id").distinct().withColumn("is_eval_user", F.lit(1))
    return (
        cand.join(positives, ["user_id", "item_id"], "left").join(known, "user_id", "left").fillna({"label": 0, "is_eval_user": 0})
    )


def candidate_features(
    preds: DataFrame, models: list[str], train: DataFrame, truth: DataFrame, users: DataFrame, top_k: int = 50
) -> DataFrame:
    """Candidates with model, item, user, pair and affinity features and the label.

    The log is read once: it is counted by user, item, brand and category, written, and everything is rolled up from that.
    User-sized tables are merged with each other first, item-sized ones likewise, so the candidate table - the largest
    by far - is shuffled once by pair, once by user and once by item (not at all where the item side is broadcast).
    """
    grain = cut(event_grain(train))
    user_affinity, item_affinity = _affinity_top1(grain)
    by_pair = attach_label_and_history(attach_model_scores(preds, models, top_k), _user_item_history(grain), truth)
    item_side = _item_popularity_of(grain).join(item_affinity, "item_id", "left")
    flags = users.select("user_id").distinct().withColumn("is_eval_user", F.lit(1))
    user_side = _user_activity_of(grain).join(user_affinity, "user_id", "left")
    out = by_pair.join(broadcast_if_small(item_side), "item_id", "left").join(user_side, "user_id", "left").join(
        flags, "user_id", "left"
    )
    match = {
        name: F.coalesce((F.col(f"user_top_{kind}") == F.col(f"item_{kind}")).cast("int"), F.lit(0))
        for name, kind in (("brand_match", "brand"), ("category_match", "category"))
    }
    return out.withColumns(match).fillna({"is_eval_user": 0})


def attach_label_and_history(cand: DataFrame, history: DataFrame, truth: DataFrame) -> DataFrame:
    """History and label of the pair; all three sides are hashed by (user, item), so nothing is shuffled twice."""
    positives = truth.select("user_id", "item_id").distinct().withColumn("label", F.lit(1))
    keys = ["user_id", "item_id"]
    return fill_history_nulls(cand.join(history, keys, "left").join(positives, keys, "left"))


def union_models(preds: dict[str, DataFrame]) -> DataFrame:
    """Long table of several models' predictions."""
    return union_all(df.withColumn("model", F.lit(name)) for name, df in preds.items())
