"""Fusion of several models' ranked lists.

All functions take one long table ``(model, user_id, item_id, score, rank)``; see ``features.union_models``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import lookup
from basketry.operators.distributed import top_rows
from basketry.operators.metrics import evaluate_models
from basketry.operators.windows import minmax_within_user, zscore_global
from basketry.runtime import require_columns, require_positive

PLACES = 9  # scores that differ only by the order of summation count as equal


def _fuse(parts: DataFrame, value: Column, n: int) -> DataFrame:
    fused = parts.groupBy("user_id", "item_id").agg(F.round(F.sum(value), PLACES).alias("score"))
    return top_rows(fused, ["user_id"], [F.desc("score"), F.asc("item_id")], n)


def _weighted(preds: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Rows of models with a weight other than zero; without weights every model counts one."""
    if weights is None:
        return preds.withColumn("_weight", F.lit(1.0))
    used = {m: float(w) for m, w in weights.items() if w != 0}
    if not used:
        raise ValueError("no model has a weight")
    return preds.filter(F.col("model").isin(list(used))).withColumn("_weight", lookup(F.col("model"), used))


def rrf(preds: DataFrame, k: int = 60, n: int = 50, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of weight over (k + rank), best ``n`` per user."""
    require_columns(preds, "model", "user_id", "item_id", "rank")
    require_positive(n=n)
    return _fuse(_weighted(preds, weights), F.col("_weight") / (k + F.col("rank")), n)


def rrf_lists(frames: list[DataFrame], k: int = 60, n: int = 50, weights: list[float] | None = None) -> DataFrame:
    """The same for a list of tables without a model column."""
    from basketry.operators.features import union_models

    if not frames:
        raise ValueError("no predictions given")
    if weights is not None and len(weights) != len(frames):
        raise ValueError(f"{len(weights)} weights for {len(frames)} models")
    for frame in frames:
        require_columns(frame, "user_id", "item_id", "rank")
    long = union_models({str(i): f.select("user_id", "item_id", "rank") for i, f in enumerate(frames)})
    return rrf(long, k, n, None if weights is None else {str(i): w for i, w in enumerate(weights)})


def weighted_minmax(preds: DataFrame, weights: dict[str, float] | None = None, n: int = 50) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 inside each user's list of a model."""
    scaled = minmax_within_user(_weighted(preds, weights), ("model", "user_id"))
    return _fuse(scaled, F.col("_weight") * F.col("norm_score"), n)


def weighted_zscore(preds: DataFrame, weights: dict[str, float] | None = None, n: int = 50) -> DataFrame:
    """Weighted sum of scores in standard deviations; an absent item counts as the mean of that model."""
    scaled = zscore_global(_weighted(preds, weights))
    return _fuse(scaled, F.col("_weight") * F.col("norm_score"), n)


def sweep_lists(preds: DataFrame, configs: dict[str, dict[str, float]], k: int = 60, n: int = 50) -> DataFrame:
    """Fused list of every configuration, labelled by its name in ``model``.

    The models' ranks of a pair are brought into one row first, so the predictions are shuffled once however many
    configurations there are. Models a configuration names but the table lacks add nothing; a configuration without
    any present model yields no rows.
    """
    models = sorted({m for weights in configs.values() for m in weights})
    wide = preds.filter(F.col("model").isin(models)).groupBy("user_id", "item_id").agg(
        *[F.max(F.when(F.col("model") == m, F.col("rank"))).alias(f"_r{i}") for i, m in enumerate(models)]
    )
    place = {m: i for i, m in enumerate(models)}
    entries = []
    for name, weights in configs.items():
        terms = [F.coalesce(F.lit(float(w)) / (k + F.col(f"_r{place[m]}")), F.lit(0.0)) for m, w in weights.items()]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        entries.append(F.struct(F.lit(name).alias("model"), F.round(total, PLACES).alias("score")))
    long = wide.select("user_id", "item_id", F.inline(F.array(*entries))).filter(F.col("score") > 0)
    return top_rows(long, ["model", "user_id"], [F.desc("score"), F.asc("item_id")], n)


def fusion_sweep(
    preds: DataFrame, configs: dict[str, dict[str, float]], gt: DataFrame, k: int = 60, top: int = 10
) -> DataFrame:
    """NDCG and recall of every configuration, in one job."""
    results = evaluate_models(sweep_lists(preds, configs, k), gt, top)
    return results.withColumnRenamed("model", "config")


def best_config(results: DataFrame, singles: list[str]) -> DataFrame:
    """The configuration with the highest NDCG, its lead over the best single model, and whether it is a gain.

    ``results`` has one row per configuration.
    """
    best = F.max_by(F.struct("config", "ndcg", "recall"), F.struct(F.col("ndcg"), -F.length("config")))
    single = F.max(F.when(F.col("config").isin(singles), F.col("ndcg")))
    return results.agg(best.alias("b"), single.alias("best_single")).select(
        F.col("b.config").alias("config"),
        F.col("b.ndcg").alias("ndcg"),
        F.col("b.recall").alias("recall"),
        "best_single",
        (F.col("b.ndcg") - F.col("best_single")).alias("delta"),
        (F.col("b.ndcg") - F.col("best_single") > 0).alias("improves"),
    )


def ranked_results(results: DataFrame, singles: list[str]) -> DataFrame:
    """All configurations with their difference to the best single model, best first."""
    reference = results.filter(F.col("config").isin(singles)).agg(F.max("ndcg").alias("m")).scalar()
    return results.withColumn("delta", F.col("ndcg") - reference).orderBy(F.desc("ndcg"), F.asc("config"))
