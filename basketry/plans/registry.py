"""Runnable queries and, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AREAS = ["scans", "scalars", "splits", "features", "behaviour", "ranking", "retrieval", "fusion", "carousel", "trust", "sequences"]


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def load_all() -> None:
    for area in AREAS:
        import_module(f"basketry.plans.{area}")
