"""Blocks of vectors: matrix products against plain sums, and a number of blocks that does not grow with the vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.operators import blocks, neighbors


def group(rng, n, dims, per):
    rows = [(kind, i, d, rng.random()) for kind in (0, 1) for i in range(n) for d in rng.choice(dims, per, replace=False)]
    kind, ids, dim, w = (np.array(x) for x in zip(*rows))
    none = np.zeros(len(ids), int)
    return pa.table({"kind": kind, "query_id": np.where(kind == 0, ids, none), "candidate_id": np.where(kind == 1, ids, none), "dim": dim, "w": w})


@pytest.mark.parametrize("n", [3, 60])
def test_products_like_sums(monkeypatch, n):
    table = group(np.random.default_rng(3), 40, 30, 6)
    dense = blocks.sparse_task(n, 0.0)(table)
    monkeypatch.setattr(blocks, "CELLS", 0)
    assert dense.equals(blocks.sparse_task(n, 0.0)(table))


def test_best_above():
    scores = np.round(np.random.default_rng(4).random((20, 500)), 2)
    rows, columns = blocks.best_per_row(scores, 7, 0.0)
    for floor in (None, np.sort(scores, axis=1)[:, -9]):
        got = blocks.best_above(scores, 7, 0.0, floor)
        assert (got[0] == rows).all() and (got[1] == columns).all() and (got[2] == scores[rows, columns]).all()


def test_few_blocks_for_many_short_vectors(spark):
    unit = spark.range(70_000).select(F.col("id").alias("user_id"), (F.col("id") % 50).alias("dim"), F.lit(1.0).alias("w"))
    dealt = neighbors.dealt_blocks(unit, neighbors.block_size(unit))
    assert dealt.select("block").distinct().count() <= neighbors.BLOCKS


def test_tasks_take_many_blocks(spark, monkeypatch):
    """However small the blocks, a query hands on its best from the first block and a bounded number of tasks."""
    rng = np.random.default_rng(5)
    vectors = [(i, rng.standard_normal(4).tolist()) for i in range(300)]
    queries, items = (spark.createDataFrame(vectors, f"{c} long, vector array<double>") for c in ("query_id", "candidate_id"))
    handed = []
    monkeypatch.setattr(blocks, "top_rows", lambda df, *rest, top=blocks.top_rows: handed.append(df) or top(df, *rest))
    got = blocks.dense_top(queries, items, 2, block=3)
    assert got.count() == 600
    assert handed[-1].count() <= 300 * 2 * (blocks.TASKS + 2)
