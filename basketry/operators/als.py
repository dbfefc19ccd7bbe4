"""Implicit-feedback matrix factorisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.vectors import embedding_topn
from basketry.sources.events import dense_index


def als_fit(
    inter: DataFrame, rank: int = 32, reg: float = 0.001, iterations: int = 15, alpha: float = 10.0, seed: int = 42
) -> tuple[ALSModel, DataFrame, DataFrame]:
    """Fit on ``(user_id, item_id, weight)``; returns the model and the two id maps."""
    users, items = dense_index(inter, "user_id", "user_idx"), dense_index(inter, "item_id", "item_idx")
    indexed = inter.join(users, "user_id").join(items, "item_id").select(
        F.col("user_idx").cast("int"), F.col("item_idx").cast("int"), F.col("weight").cast("float")
    )
    als = ALS(
        userCol="user_idx", itemCol="item_idx", ratingCol="weight", implicitPrefs=True, rank=rank, regParam=reg,
        maxIter=iterations, alpha=alpha, seed=seed, checkpointInterval=5, coldStartStrategy="drop",
    )
    return als.fit(indexed), users, items


def als_recommend(
    inter: DataFrame, users: DataFrame, n: int = 50, filter_seen: bool = False, **params
) -> DataFrame:
    """Best ``n`` items of each known user among ``users``: ``(user_id, item_id, score, rank)``.

    Factors are scored block by block; with ``filter_seen`` no item comes out that the user already has.
    """
    model, user_map, item_map = als_fit(inter, **params)
    wanted = user_map.join(users.select("user_id").distinct(), "user_id", "left_semi")
    queries = model.userFactors.join(wanted, F.col("id") == F.col("user_idx")).select(
        F.col("user_id").alias("query_id"), F.col("features").alias("vector")
    )
    items = model.itemFactors.join(item_map, F.col("id") == F.col("item_idx")).select(
        "item_id", F.col("features").alias("vector")
    )
    seen = inter.select(F.col("user_id").alias("query_id"), "item_id") if filter_seen else None
    return embedding_topn(queries, items, n, exclude=seen).withColumnRenamed("query_id", "user_id")


def user_equations(
    inter: DataFrame, model: ALSModel, users: DataFrame, items: DataFrame, reg: float = 0.001, alpha: float = 10.0
) -> DataFrame:
    """How far each user's factors are from solving their least-squares system: ``(user_id, residual)``, relative to its right side.

    With item factors y the factors x of a user solve ``(sum over all items of y yT + sum over own items of alpha w y yT + reg n I) x = sum
    over own items of (1 + alpha w) y``. The sum over all items is a rank x rank matrix; a user's own systems are built where the user's
    items are.
    """
    y = F.col("features").cast("array<double>")
    width = model.rank
    cells = model.itemFactors.select(y.alias("y")).select(F.posexplode("y").alias("i", "a"), "y").select("i", "a", F.posexplode("y").alias("j", "b"))
    gram = np.zeros((width, width))
    for r in cells.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v")).collect():  # rank * rank rows
        gram[r["i"], r["j"]] = r["v"]
    factors = model.itemFactors.join(items, F.col("id") == F.col("item_idx")).select("item_id", y.alias("y"))
    own = model.userFactors.join(users, F.col("id") == F.col("user_idx")).select("user_id", y.alias("x"))
    rows = inter.select("user_id", "item_id", F.col("weight").cast("float").cast("double").alias("w")).join(factors, "item_id").join(own, "user_id")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        factors, x = np.stack(pdf["y"].to_numpy()), np.asarray(pdf["x"].iloc[0])
        weight = alpha * np.abs(pdf["w"].to_numpy())
        positive = pdf["w"].to_numpy() > 0
        # The products with x come first, so that no rank x rank matrix is built for a user.
        left = gram @ x + factors.T @ (weight * (factors @ x)) + reg * positive.sum() * x
        right = factors.T @ np.where(positive, 1 + weight, 0.0)
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "residual": [np.linalg.norm(left - right) / max(np.linalg.norm(right), 1e-12)]})

    kind = inter.schema["user_id"].dataType.simpleString()
    return rows.groupBy("user_id").applyInPandas(check, f"user_id {kind}, residual double")
