"""Item co-occurrence and item-to-item ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.block_matrix import BLOCKS, SCHEMA, BlockMatrix, dense, diagonal, inverse, lower_blocks, sparse_times_dense
from basketry.operators.blocks import BLOCK, sparse_top
from basketry.operators.distributed import sorted_index, top_rows
from basketry.runtime import cut, require_positive


def item_gram(inter: DataFrame, block: int = 256) -> DataFrame:
    """``G = XᵀX`` as ``(item_i, item_j, value)``: sum over users of the product of their weights for two items.

    The items of a user are dealt into blocks of about ``block``. Pairs are formed per pair of blocks, so the largest
    history is spread over many tasks; only half of the matrix is computed and sums are combined before the shuffle.
    """
    require_positive(block=block)
    sizes = inter.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = inter.join(sizes, "user_id").withColumn("_b", F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int"))
    last = F.col("_blocks") - 1
    left = dealt.select(
        "user_id", F.col("item_id").alias("a"), F.col("weight").alias("wa"), F.col("_b").alias("lo"),
        F.explode(F.sequence(F.col("_b"), last)).alias("hi"),
    )
    right = dealt.select(
        "user_id", F.col("item_id").alias("b"), F.col("weight").alias("wb"), F.col("_b").alias("hi"),
        F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("lo"),
    )
    pairs = left.join(right, ["user_id", "lo", "hi"]).filter((F.col("lo") < F.col("hi")) | (F.col("a") <= F.col("b")))
    half = pairs.groupBy(F.least("a", "b").alias("item_i"), F.greatest("a", "b").alias("item_j")).agg(
        F.sum(F.col("wa") * F.col("wb")).alias("value")
    )
    both = F.array(
        F.struct(F.col("item_i").alias("i"), F.col("item_j").alias("j")),
        F.when(F.col("item_i") != F.col("item_j"), F.struct(F.col("item_j").alias("i"), F.col("item_i").alias("j"))),
    )
    return half.select(F.explode(F.array_compact(both)).alias("p"), "value").select(
        F.col("p.i").alias("item_i"), F.col("p.j").alias("item_j"), "value"
    )


def item_ridge(gram: DataFrame, lam: float = 200.0, k_neighbors: int | None = None, block: int = 512) -> DataFrame:
    """Weights ``B`` of predicting each item from all others, as ``(item_i, item_j, weight)`` with target ``item_j``.

    Without ``k_neighbors`` this is the closed form from the inverse of ``G + λI``. With it, each item is regressed on
    the items it occurs with most, which needs one small system per item instead of the inverse.
    """
    require_positive(lam=lam)
    if k_neighbors is None:
        return closed_form(gram, lam, block).weights()
    return _ridge_by_neighbors(gram, lam, k_neighbors)


def _ridge_by_neighbors(gram: DataFrame, lam: float, k: int) -> DataFrame:
    near = cut(
        top_rows(
            gram.filter(F.col("item_i") != F.col("item_j")), ["item_j"], [F.desc("value"), F.asc("item_i")], k
        ).select(F.col("item_j").alias("target"), F.col("item_i").alias("a"), F.col("value").alias("rhs"))
    )
    # A target has at most k neighbours, so at most half of k squared cells of G are looked up for it.
    others = near.select("target", F.col("a").alias("b"))
    cells = near.join(others, "target").filter(F.col("a") <= F.col("b"))
    lookup = gram.select(F.col("item_i").alias("a"), F.col("item_j").alias("b"), "value")
    # Neighbours that never occur together have no cell; the diagonal always exists, so no neighbour gets lost.
    system = cells.join(lookup, ["a", "b"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["a"].to_numpy())  # every neighbour is an ``a``, if only for its own diagonal cell
        a = np.zeros((len(names), len(names)))
        y = np.zeros(len(names))
        ia, ib = (np.searchsorted(names, pdf[c].to_numpy()) for c in ("a", "b"))
        a[ia, ib] = a[ib, ia] = pdf["value"].to_numpy()
        y[ia] = pdf["rhs"].to_numpy()
        a[np.diag_indices(len(names))] += lam
        return pd.DataFrame({"item_i": names, "item_j": pdf["target"].iloc[0], "weight": np.linalg.solve(a, y)})

    kind = gram.schema["item_i"].dataType.simpleString()
    return system.groupBy("target").applyInPandas(solve, f"item_i {kind}, item_j {kind}, weight double")


@dataclass
class ItemRidge:
    """Closed-form weights B in dense blocks, and the items' places in them: ``index`` is ``(item_id, i)``."""

    index: DataFrame
    inverse: BlockMatrix

    def weight_blocks(self) -> DataFrame:
        """B in square blocks: minus the inverse, each column divided by its diagonal cell; zero on the diagonal."""
        block = self.inverse.block
        scale = diagonal(self.inverse).select(F.floor(F.col("i") / block).cast("int").alias("bj"), F.struct("i", "value").alias("cell"))
        scale = scale.groupBy("bj").agg(F.sort_array(F.collect_list("cell"))["value"].alias("scale"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    by = np.array(r["scale"])
                    if not (by > 0).all():
                        raise ValueError("the inverse has a diagonal that is not positive")
                    out = -dense(r["data"], r["rows"]) / by
                    if r["bi"] == r["bj"]:
                        np.fill_diagonal(out, 0.0)
                    yield pa.RecordBatch.from_pylist([{"bi": r["bi"], "bj": r["bj"], "rows": r["rows"], "data": out.tobytes()}], SCHEMA)

        return self.inverse.full().join(scale, "bj").select("bi", "bj", "rows", "data", "scale").mapInArrow(run, BLOCKS)

    def weights(self) -> DataFrame:
        """B as ``(item_i, item_j, weight)``, one row per cell that is not zero."""
        block = self.inverse.block

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    whole = dense(r["data"], r["rows"])
                    i, j = np.nonzero(whole)
                    yield pa.RecordBatch.from_arrays([pa.array(i + r["bi"] * block), pa.array(j + r["bj"] * block), pa.array(whole[i, j])], ["i", "j", "weight"])

        found = self.weight_blocks().mapInArrow(cells, "i long, j long, weight double")
        return found.join(self.index.select("i", F.col("item_id").alias("item_i")), "i").join(
            self.index.select(F.col("i").alias("j"), F.col("item_id").alias("item_j")), "j"
        ).select("item_i", "item_j", "weight")

    def scores(self, inter: DataFrame, n: int = 50, filter_seen: bool = False) -> DataFrame:
        """``X·B``: each user's items vote for others; best ``n`` per user, optionally without what the user has."""
        users = cut(inter.join(self.index, "item_id").select(F.col("user_id").alias("row_id"), "i", F.col("weight").alias("w")))
        best = sparse_times_dense(users, self.weight_blocks(), self.inverse.size, self.inverse.block, n, filter_seen)
        return best.join(self.index.select(F.col("i").alias("j"), "item_id"), "j").select(F.col("row_id").alias("user_id"), "item_id", "score", "rank")


def closed_form(gram: DataFrame, lam: float = 200.0, block: int = 512) -> ItemRidge:
    """The ridge regression of each item on all others, from the inverse of ``G + λI`` in blocks. Runs jobs."""
    require_positive(lam=lam)
    items = gram.select(F.col("item_i").alias("item_id")).distinct()
    # Places follow the order of ids, so that ties between items go to the smaller id.
    index = cut(sorted_index(items, ["item_id"], "i"))
    n = index.count()
    cells = gram.join(index.select(F.col("item_id").alias("item_i"), "i"), "item_i").join(
        index.select(F.col("item_id").alias("item_j"), F.col("i").alias("j")), "item_j"
    )
    matrix = lower_blocks(cells.select("i", "j", "value"), n, lam, block)
    out = ItemRidge(index, inverse(matrix))
    matrix.delete()
    return out


def normal_equations(gram: DataFrame, weights: DataFrame, lam: float) -> DataFrame:
    """How far weights are from solving their ridge regressions: ``(item_j, residual)``.

    The weights of target j solve ``sum_i (G + λI)_ki B_ij = G_kj`` for all k other than j; the residual is the largest difference.
    """
    ridge = gram.select("item_i", "item_j", F.when(F.col("item_i") == F.col("item_j"), F.col("value") + lam).otherwise(F.col("value")).alias("g"))
    left = ridge.select(F.col("item_i").alias("k"), F.col("item_j").alias("i"), "g").join(
        weights.select(F.col("item_i").alias("i"), F.col("item_j").alias("j"), "weight"), "i"
    )
    got = left.groupBy("k", "j").agg(F.sum(F.col("g") * F.col("weight")).alias("part"))
    wanted = gram.select(F.col("item_i").alias("k"), F.col("item_j").alias("j"), (-F.col("value")).alias("part"))
    off = got.unionByName(wanted).filter(F.col("k") != F.col("j")).groupBy("k", "j").agg(F.sum("part").alias("off"))
    own = gram.filter("item_i = item_j").select(F.col("item_i").alias("j"), F.lit(0.0).alias("off"))
    return off.select("j", "off").unionByName(own).groupBy(F.col("j").alias("item_j")).agg(F.max(F.abs("off")).alias("residual"))


def item_ridge_scores(inter: DataFrame, weights: DataFrame, n: int = 50, filter_seen: bool = False, block: int = BLOCK) -> DataFrame:
    """``X·B`` for weights as rows: each user's items vote for others; best ``n`` per user, optionally without what the user has.

    This is for the sparse weights of ``k_neighbors``; dense ones stay in blocks, see ``ItemRidge.scores``. Users meet items block against block, so votes are added up inside a task and only the best of each block are shuffled.
    """
    users = cut(inter.select(F.col("user_id").alias("query_id"), F.col("item_id").alias("dim"), F.col("weight").alias("w")))
    items = cut(weights.select(F.col("item_j").alias("candidate_id"), F.col("item_i").alias("dim"), F.col("weight").alias("w")))
    seen = inter.select(F.col("user_id").alias("query_id"), F.col("item_id").alias("candidate_id")) if filter_seen else None
    best = sparse_top(users, items, n, seen, block, least=None)
    return best.select(F.col("query_id").alias("user_id"), F.col("candidate_id").alias("item_id"), "score", "rank")
