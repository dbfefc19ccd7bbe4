"""Inputs that several queries share."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.scalars import half_up
from basketry.operators import splits
from basketry.sources import fixtures

MODELS = ["freq", "recency", "spend"]


class Parts(NamedTuple):
    log: DataFrame
    train: DataFrame
    truth: DataFrame
    gt: DataFrame
    users: DataFrame


def parts(spark: SparkSession, sf: str) -> Parts:
    log = fixtures.activity_log(spark, sf)
    train, truth = splits.time_based_split(log)
    return Parts(log, train, truth, splits.ground_truth(truth, train), splits.eval_users(truth, train))


def preds(train: DataFrame) -> DataFrame:
    return fixtures.model_predictions(train)


def one_model(train: DataFrame, model: str) -> DataFrame:
    return preds(train).filter(F.col("model") == model).drop("model")


def day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All double columns to six places, dates as text; ``keep`` limits the columns."""
    out = []
    for field in df.schema.fields:
        if keep and field.name not in keep:
            continue
        kind = field.dataType.typeName()
        column = F.col(field.name)
        if kind == "double":
            column = half_up(column, 6)
        elif kind == "date":
            column = day(column)
        out.append(column.alias(field.name))
    return df.select(*out)


def shop(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.shopping(fixtures.activity_log(spark, sf))
