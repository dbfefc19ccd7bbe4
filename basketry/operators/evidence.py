"""Evidence for recommendations: what is known about a user, an item and the pair, as one nested table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.scalars import price_fit
from basketry.operators import context, features
from basketry.operators.carousel import revisit
from basketry.operators.distributed import top_rows

# Fields of the three parts of an evidence document, in order.
CONTEXT_FIELDS = [
    "total_events", "recent14_events", "top_categories", "top_brands", "carted_brands", "purchased_brands",
    "price_median", "price_p25", "price_p75", "price_iqr",
]
SIGNAL_FIELDS = [
    "item_pop_log1p", "item_recent14_pop_log1p", "models_recommending", "ranks", "model_hit_count", "ensemble_rank",
    "cart_boosted", "seen_before", "carted_before", "purchased_before", "brand_affinity", "category_l2_affinity",
    "price_in_user_band", "price_distance_to_user_median", "item_view_count", "item_cart_count", "item_purchase_count",
    "item_v2c_smoothed", "item_v2p_smoothed", "item_recent14_view_count", "item_prev14_view_count",
    "item_recent_trend_ratio", "revisit_score", "last_event_type", "last_interaction_days", "revisit_event_count",
    "cart_without_purchase",
]
ITEM_FIELDS = ["rank", "item_id", "category_code", "category_l2", "brand", "price"]
COUNTS = [
    "item_pop_log1p", "item_recent14_pop_log1p", "item_view_count", "item_cart_count", "item_purchase_count",
    "item_v2c_smoothed", "item_v2p_smoothed", "item_recent14_view_count", "item_prev14_view_count", "item_recent_trend_ratio",
]
REVISIT_FIELDS = {
    "revisit_score": "double", "last_event_type": "string", "last_interaction_days": "int",
    "revisit_event_count": "long", "cart_without_purchase": "boolean",
}


def model_rank_maps(preds: DataFrame, top: int = 50) -> DataFrame:
    """Per (user, item) the rank each model gives it; there are as many entries as models."""
    entries = F.sort_array(F.collect_list(F.struct("model", F.col("rank").cast("int"))))
    ranked = preds.filter(F.col("rank") <= top).groupBy("user_id", "item_id").agg(entries.alias("_e"))
    return ranked.select("user_id", "item_id", F.map_from_entries("_e").alias("ranks"))


def item_evidence(
    recs: DataFrame,
    base: DataFrame,
    user_context: DataFrame,
    history: DataFrame,
    model_ranks: DataFrame | None = None,
) -> DataFrame:
    """Evidence for each row of ``recs`` (``user_id, item_id, rank``, optionally revisit columns).

    ``base`` are the item signals, ``history`` the flags per (user, item) seen. ``model_ranks`` may bring ``ranks`` and,
    if known, ``ensemble_rank`` and ``cart_boosted``; without it the rank of the list stands for the fused rank.
    """
    keys = ["user_id", "item_id"]
    joined = recs.join(history.select(*keys, "viewed", "carted", "purchased"), keys, "left")
    extra = {
        "ranks": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")),
        "ensemble_rank": F.lit(None).cast("int"),
        "cart_boosted": F.lit(False),
    }
    if model_ranks is not None:
        joined = joined.join(model_ranks, keys, "left")
    for name, default in extra.items():
        known = model_ranks is not None and name in model_ranks.columns
        joined = joined.withColumn(name, F.coalesce(F.col(name), default) if known else default)
    for name, kind in REVISIT_FIELDS.items():
        missing = F.lit(False) if kind == "boolean" else F.lit(None).cast(kind)
        joined = joined.withColumn(name, F.coalesce(F.col(name), missing) if name in recs.columns else missing)
    if model_ranks is not None and "revisit_score" in recs.columns:
        # Items to revisit come from the user's own history, whatever the models say about them.
        again = F.col("revisit_score").isNotNull()
        joined = joined.withColumns(
            {n: F.when(again, default).otherwise(F.col(n)) for n, default in extra.items() if n in model_ranks.columns}
        )
    joined = joined.join(base, "item_id", "left").join(user_context, "user_id", "left")
    liked = F.array_union(F.array_union("top_brands", "carted_brands"), "purchased_brands")
    in_band, distance = price_fit(F.col("price"), F.col("price_median"), F.col("price_iqr"))

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    signals = {
        **{c: F.coalesce(F.col(c), F.lit(0).cast(base.schema[c].dataType)) for c in COUNTS},
        "models_recommending": F.map_keys("ranks"),
        "ranks": F.col("ranks"),
        "model_hit_count": F.size("ranks"),
        "ensemble_rank": F.coalesce(F.col("ensemble_rank"), F.col("rank").cast("int")),
        "cart_boosted": F.col("cart_boosted"),
        "seen_before": flag(F.col("viewed")),
        "carted_before": flag(F.col("carted")),
        "purchased_before": flag(F.col("purchased")),
        "brand_affinity": flag(F.array_contains(liked, F.col("brand"))),
        "category_l2_affinity": flag(F.array_contains("top_categories", F.col("category_l2"))),
        "price_in_user_band": in_band,
        "price_distance_to_user_median": distance,
        **{c: F.col(c) for c in REVISIT_FIELDS},
    }
    return joined.select(
        "user_id",
        *[F.col(c) for c in ITEM_FIELDS],
        F.struct(*[signals[c].alias(c) for c in SIGNAL_FIELDS]).alias("signals"),
        F.struct(*[F.col(c) for c in CONTEXT_FIELDS]).alias("user_context"),
    )


def evidence_revisit(recs: DataFrame, events: DataFrame, n: int = 3, longest: int = 10, tie: str = "event_id") -> DataFrame:
    """Up to ``n`` items to revisit that are not recommended already; their ranks follow the recommendations.

    A list holds at most ``longest`` items, so the first ``longest + n`` revisit items always leave enough.
    """
    length = recs.groupBy("user_id").agg(F.max("rank").alias("_length"))
    again = revisit(events, longest + n, tie).withColumnRenamed("rank", "_rank")
    fresh = again.join(recs.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").join(length, "user_id")
    best = top_rows(fresh, ["user_id"], [F.asc("_rank")], n, "_place")
    return best.withColumn("rank", (F.col("_length") + F.col("_place")).cast("int")).drop("_rank", "_place", "_length")


def evidence_rows(
    recs: DataFrame, log: DataFrame, model_ranks: DataFrame | None = None, with_revisit: bool = True, longest: int = 10
) -> DataFrame:
    """Evidence rows of all users from the recommendations and the log, with the revisit items behind them."""
    wanted = recs.select("user_id", "item_id", F.col("rank").cast("int").alias("rank"))
    base = features.item_signals_base(log)
    about = context.user_context(log)
    history = context.profile_items(log)
    if with_revisit:
        shopping = log.filter(F.col("event_type").isin("view", "cart", "purchase"))
        wanted = wanted.unionByName(evidence_revisit(wanted, shopping, longest=longest), allowMissingColumns=True)
    return item_evidence(wanted, base, about, history, model_ranks)


def evidence_pack(rows: DataFrame) -> DataFrame:
    """One nested row per user: context and recommendations in rank order. Lists are short by construction."""
    item = F.struct(*ITEM_FIELDS, "signals")
    return rows.groupBy("user_id").agg(
        F.first("user_context").alias("user_context"),
        F.array_sort(F.collect_list(item), lambda a, b: a["rank"] - b["rank"]).alias("recommendations"),
    )


def unpack(packs: DataFrame) -> DataFrame:
    """Back to one row per recommendation."""
    return packs.select("user_id", "user_context", F.explode("recommendations").alias("r")).select(
        "user_id", *[f"r.{c}" for c in ITEM_FIELDS], "r.signals", "user_context"
    )


def key_names() -> list[str]:
    """Keys a claim may cite."""
    return (
        [f"user_context.{c}" for c in CONTEXT_FIELDS]
        + [f"signals.{c}" for c in SIGNAL_FIELDS]
        + [f"recommendation.{c}" for c in ITEM_FIELDS]
    )


def evidence_keys(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The same as a table, taken from the schema of evidence rows."""
    keys = [f"{part}.{f.name}" for part in ("user_context", "signals") for f in schema[part].dataType.fields]
    keys += [f"recommendation.{c}" for c in ITEM_FIELDS]
    return spark.createDataFrame([(k,) for k in sorted(keys)], "key string")


def _support(value: Column, kind: T.DataType) -> Column:
    """Whether a value can carry a claim: true, above zero, or not empty."""
    if isinstance(kind, T.BooleanType):
        found = value
    elif isinstance(kind, T.NumericType):
        found = value > 0
    elif isinstance(kind, T.StringType):
        found = F.length(value) > 0
    else:
        found = F.size(value) > 0
    return F.coalesce(found, F.lit(False))


def quoted(text: Column) -> Column:
    """A text between single quotes, or double ones if only the single ones occur in it."""
    mark = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, text, mark)


def _shown(value: Column, kind: T.DataType) -> Column:
    """A value as failures name it."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value.cast("array<string>"), quoted), ", "), F.lit("]"))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("None")).otherwise(text)


def support_columns(rows: DataFrame, inside: str = "") -> dict[str, Column]:
    """Three maps by key: whether the value supports a claim, whether it is a true flag, and the value as text.

    ``rows`` gives the schema; ``inside`` names the column and a dot if its fields are found in a nested column.
    The maps have one entry per field of the schema, so claims can be checked row by row without unpivoting.
    """
    supported, is_true, shown = [], [], []
    for part, prefix in (("user_context", "user_context"), ("signals", "signals"), (None, "recommendation")):
        fields = rows.schema[part].dataType.fields if part else [rows.schema[c] for c in ITEM_FIELDS]
        for f in fields:
            value = F.col(f"{inside}{part}.{f.name}" if part else f"{inside}{f.name}")
            flag = _support(value, f.dataType)
            supported.append((f"{prefix}.{f.name}", flag))
            is_true.append(flag if isinstance(f.dataType, T.BooleanType) else F.lit(False))
            shown.append(_shown(value, f.dataType))
    keys = F.array(*[F.lit(k) for k, _ in supported])
    return {
        "supported": F.map_from_arrays(keys, F.array(*[flag for _, flag in supported])),
        "is_true": F.map_from_arrays(keys, F.array(*is_true)),
        "shown": F.map_from_arrays(keys, F.array(*shown)),
    }


def support_maps(rows: DataFrame) -> DataFrame:
    """The three maps of each recommendation."""
    return rows.select("user_id", "item_id", *[c.alias(n) for n, c in support_columns(rows).items()])


def evidence_value(rows: DataFrame) -> DataFrame:
    """One row per (user, item, key): whether the value supports a claim, and whether it is a flag that is true."""
    maps = support_maps(rows)
    return maps.select("user_id", "item_id", F.explode("supported").alias("key", "supported"), "is_true").withColumn(
        "is_true", F.element_at("is_true", F.col("key"))
    )
