"""Cross-validated reranking of candidates with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import feature_columns
from basketry.operators.distributed import top_rows
from basketry.operators.metrics import ndcg_at_k, recall_at_k
from basketry.operators.splits import user_folds
from basketry.runtime import cut, union_all

PLACES = 9


def training_table(features: DataFrame, folds: int = 5, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Candidates of evaluable users with a fold per user and one vector of all features, stored once.

    Both sides are shuffled by user: candidates are small as files, so Spark would broadcast them and store the table in the one
    or two tasks that hold the folds, and every fit would have no more tasks than that. Rows are stored in order, as the
    boosted trees draw rows by their place.
    """
    names = feature_columns(features)
    chosen = features.filter(F.col("is_eval_user") == 1)
    vectors = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(
        chosen.fillna(0, names)
    )
    rows = vectors.select("user_id", "item_id", F.col("label").cast("double").alias("label"), "features")
    with_fold = rows.join(user_folds(chosen, folds, seed).hint("merge"), "user_id")
    return cut(with_fold.sortWithinPartitions("user_id", "item_id")), names


def scoring_table(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(user_id, item_id, features)`` of every candidate of every user, in the order of ``names`` that a model was fitted with."""
    missing = [n for n in names if n not in features.columns]
    if missing:
        raise ValueError(f"features missing: {', '.join(missing)}")
    assembler = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error")
    return assembler.transform(features.fillna(0, list(names))).select("user_id", "item_id", "features")


def _score(model: Model, df: DataFrame) -> DataFrame:
    raw = vector_to_array("rawPrediction")[1]
    return model.transform(df).select("user_id", "item_id", "label", "fold", F.round(raw, PLACES).alias("score"))


def rerank_binary(
    table: DataFrame,
    folds: int = 5,
    trees: int = 20,
    depth: int = 5,
    step: float = 0.1,
    seed: int = 42,
    stop_early: bool = False,
    least_leaf: int = 1,
    feature_share: float = 1.0,
) -> tuple[DataFrame, list[Model]]:
    """Boosted trees on the label, one model per left-out fold; returns out-of-fold scores and the models.

    With ``stop_early`` a tenth of the users of the other folds, by hash, tells when further trees stop helping. A leaf has
    ``least_leaf`` rows or more, and each split looks at ``feature_share`` of the features.
    """
    booster = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed,
        subsamplingRate=0.8, checkpointInterval=10, minInstancesPerNode=least_leaf,
        featureSubsetStrategy="all" if feature_share >= 1 else str(feature_share),
    )
    if stop_early:
        booster = booster.setValidationIndicatorCol("watched")
        drawn = table.withColumn("_h", F.xxhash64("user_id", F.lit(seed)))
        # One user of each fold at least, so that there is something to watch; one row per fold is joined.
        first = drawn.groupBy("fold").agg(F.min("_h").alias("_first"))
        watched = (F.pmod("_h", F.lit(10)) == 0) | (F.col("_h") == F.col("_first"))
        table = cut(drawn.join(first, "fold").withColumn("watched", watched).drop("_h", "_first"))
    models = [booster.fit(table.filter(F.col("fold") != fold)) for fold in range(folds)]
    scored = [_score(model, table.filter(F.col("fold") == fold)) for fold, model in enumerate(models)]
    return union_all(scored), models


def preference_pairs(table: DataFrame, negatives: int | None = None, seed: int = 42) -> DataFrame:
    """Feature differences between a user's bought candidates and the others, half of them turned round.

    Candidate lists are short by construction (some tens per model), and so is the number of pairs of a user. A number
    of ``negatives`` makes each positive meet only so many others, those that a seeded hash puts first.
    """
    values = table.select("user_id", "item_id", "label", vector_to_array("features").alias("_x"))
    losers = values.filter("label = 0").withColumn("_h", F.xxhash64("user_id", "item_id", F.lit(seed)))
    if negatives is not None:
        losers = top_rows(losers, ["user_id"], [F.asc("_h"), F.asc("item_id")], negatives, "_r")
    winners = values.filter("label = 1").select("user_id", F.col("_x").alias("_w"))
    pairs = winners.join(losers.select("user_id", "_x", "_h"), "user_id")
    up = (F.pmod("_h", F.lit(2)) == 0).cast("double")
    difference = F.zip_with("_w", "_x", lambda a, b: (a - b))
    signed = F.when(up == 1, difference).otherwise(F.transform(difference, lambda d: -d))
    return pairs.select(up.alias("label"), signed.alias("difference"))


def rerank_pairwise(
    table: DataFrame, folds: int = 5, negatives: int | None = None, seed: int = 42, reg: float = 0.01
) -> tuple[DataFrame, list[tuple[Model, Model]]]:
    """Ranking objective: a linear score that puts bought candidates of a user before others.

    The logistic loss of feature differences within a user is the pairwise ranking loss; the fitted weights then score
    single candidates.
    """
    from pyspark.ml.functions import array_to_vector

    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    models, scored = [], []
    for fold in range(folds):
        train = table.filter(F.col("fold") != fold)
        scale = scaler.fit(train)
        scaled = scale.transform(train).drop("features").withColumnRenamed("scaled", "features")
        pairs = preference_pairs(scaled, negatives, seed).select("label", array_to_vector("difference").alias("features"))
        model = LogisticRegression(fitIntercept=False, standardization=False, regParam=reg, maxIter=50).fit(pairs)
        models.append((scale, model))
        held_out = scale.transform(table.filter(F.col("fold") == fold)).drop("features")
        scored.append(_score(model, held_out.withColumnRenamed("scaled", "features")))
    return union_all(scored), models


def ranked(scored: DataFrame, n: int = 10) -> DataFrame:
    """Scores as ranked predictions."""
    return top_rows(scored.select("user_id", "item_id", "score"), ["user_id"], [F.desc("score"), F.asc("item_id")], n)


FoldModel = Model | tuple[Model, Model]


def score_fold_average(table: DataFrame, models: Sequence[FoldModel], n: int = 50) -> DataFrame:
    """Mean score of the fold models, best ``n`` per user. ``table`` has ``user_id, item_id, features`` (see ``scoring_table``).

    Models are those of ``rerank_binary`` or, each with its scaler, of ``rerank_pairwise``. Each adds one column to the same
    rows, so nothing is joined.
    """
    rows, total = table.select("user_id", "item_id", "features"), None
    for i, model in enumerate(models):
        if isinstance(model, tuple):
            scale, model = model
            scaled = scale.transform(rows).withColumnsRenamed({"features": "_plain", "scaled": "features"})
            out = model.transform(scaled).drop("features").withColumnRenamed("_plain", "features")
        else:
            out = model.transform(rows)
        rows = out.withColumn(f"_s{i}", vector_to_array("rawPrediction")[1]).drop(
            "rawPrediction", "probability", "prediction"
        )
        part: Column = F.col(f"_s{i}")
        total = part if total is None else total + part
    return ranked(rows.withColumn("score", F.round(total / len(models), PLACES)), n)


def save_fold_models(models: Sequence[FoldModel], path: str) -> None:
    """Write the fold models under ``path``; a folder that is there already is not overwritten."""
    for fold, model in enumerate(models):
        stages = list(model) if isinstance(model, tuple) else [model]
        PipelineModel(stages).save(f"{path}/fold={fold}")


def load_fold_models(path: str, folds: int = 5) -> list[FoldModel]:
    stages = [PipelineModel.load(f"{path}/fold={fold}").stages for fold in range(folds)]
    return [s[0] if len(s) == 1 else tuple(s) for s in stages]


def fold_metrics(oof: DataFrame, gt: DataFrame, folds: int = 5, k: int = 10) -> DataFrame:
    """NDCG and recall of each fold's own users."""
    out = []
    for fold in range(folds):
        part = oof.filter(F.col("fold") == fold)
        users = part.select("user_id").distinct()
        truth = gt.join(users, "user_id", "left_semi")
        best = ranked(part, k)
        recall = recall_at_k(best, truth, k).select("recall").scalar()
        out.append(ndcg_at_k(best, truth, k).select(F.lit(fold).alias("fold"), "ndcg", recall.alias("recall")))
    return union_all(out)


def oof_report(oof: DataFrame, baseline: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """Out-of-fold NDCG and recall, those of a baseline model, and the differences. One row."""
    best = ranked(oof, k)
    columns = {
        "recall": recall_at_k(best, gt, k).select("recall").scalar(),
        "baseline_ndcg": ndcg_at_k(baseline, gt, k).select("ndcg").scalar(),
        "baseline_recall": recall_at_k(baseline, gt, k).select("recall").scalar(),
    }
    row = ndcg_at_k(best, gt, k).withColumns(columns)
    return row.select(
        "*",
        (F.col("ndcg") - F.col("baseline_ndcg")).alias("ndcg_delta"),
        (F.col("recall") - F.col("baseline_recall")).alias("recall_delta"),
    )


def feature_gain(models: Sequence[Model], names: Sequence[str], spark, n: int = 20) -> DataFrame:
    """Importance of each feature averaged over the fold models, the ``n`` largest. As many rows as features."""
    total = [0.0] * len(names)
    for model in models:
        for i, value in zip(*_sparse(model.featureImportances)):
            total[int(i)] += float(value) / len(models)
    rows = list(zip(names, total))
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), F.asc("feature")).limit(n)


def _sparse(vector) -> tuple:
    dense = vector.toArray()
    return range(len(dense)), dense
