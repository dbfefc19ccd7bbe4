"""Exact inner-product top k by the threshold algorithm, in blocks.

Candidates and queries are dealt into blocks of bounded size, and every block of queries meets every block of candidates in
one task. There each dimension has a list of the block's candidates sorted by that component. A query reads the lists of its
non-zero dimensions in step, from the high end where its own component is positive and from the low end where it is negative,
and scores the candidates that it meets for the first time. What it has not met cannot score more than the sum of the list
values at the current depth; when that is below the k-th best score, it stops. Depths double, so a step costs one matrix product.

Components are floor(scale * x), as integers; scores are exact integers of any size, cut to 64 bits only in the output.

Defined results: rows without id, without vector, or with a null or non-finite component take no part; a vector shorter than
others has zeros behind its end; rows with a query's own id are no candidates for it; rows of equal id and quantised
vector are one query, but separate candidates; ties go to the smaller id; fewer candidates than k give fewer rows; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 4096
QUERIES = 1024
FIRST_DEPTH = 16
EXACT_FLOAT = 1 << 53


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _quantised(vector: Column, scale: int) -> Column:
    """The components as whole numbers, without zeros at the end."""
    exact = lambda x: F.when(F.abs(x) < EXACT_FLOAT, F.floor(x).cast("double")).otherwise(x)
    whole = F.transform(vector, lambda x: exact(x.cast("double") * scale))
    last = F.array_max(F.transform(whole, lambda x, n: F.when(x != 0, n + 1).otherwise(0)))
    return F.slice(whole, F.lit(1), F.coalesce(last, F.lit(0)))


def _matrix(column: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """Quantised vectors as rows of floats with integer values, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(values * scale)
    return out


def threshold_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the best ``k`` candidates of each query, by position."""
    # Ascending ids, so that the smaller position wins a tie.
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    if most >= EXACT_FLOAT:
        queries, vectors = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, vectors))
    size = len(vectors)
    order = np.argsort(vectors, axis=0, kind="stable")
    out = []
    for n, query in enumerate(queries):
        dims = np.flatnonzero(query != 0)
        rising = query[dims] < 0
        seen = np.zeros(size, bool)
        own = ids == query_ids[n]
        best = np.zeros(0, np.int64)
        scores = vectors[:0] @ query
        depth, reach = 0, FIRST_DEPTH
        while depth < size:
            reach = min(reach, size)
            if len(dims):
                at = np.arange(depth, reach)
                lists = np.where(rising, at[:, None], size - 1 - at[:, None])
                met = np.zeros(size, bool)
                met[order[lists, dims]] = True
                bound = (vectors[order[lists[-1], dims], dims] * query[dims]).sum()
            else:
                met, bound, reach = np.ones(size, bool), 0, size
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[~own[new]]
            best, scores = np.concatenate([best, new]), np.concatenate([scores, vectors[new] @ query])
            if len(best) > k:
                top = np.lexsort((best, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(best)), key=lambda i: (-scores[i], best[i]))[:k])
                best, scores = best[top], scores[top]
            depth, reach = reach, reach * 2
            if len(best) == k and scores.min() > bound:
                break
        out.extend((n, int(b), int(s)) for b, s in zip(best.tolist(), scores.tolist()))
    return out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` picks, its ``k`` best among all others. Runs a count."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    # Equal ids with different vectors are different queries. They are marked here, as each block pads to a length of its own.
    asking = rows.filter("asks").groupBy("id", F.xxhash64(_quantised(F.col("vector"), scale)).alias("mark")).agg(F.first("vector").alias("vector"))
    every, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    candidate_blocks, query_blocks = -(-every // CANDIDATES) or 1, -(-asked // QUERIES) or 1
    # The places of rows in blocks are drawn, so that equal rows do not gather.
    deal = lambda n, seed: F.floor(F.rand(seed) * n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    offered = rows.select("id", "vector", F.lit(None).cast("long").alias("mark"), F.lit(False).alias("asks"), deal(candidate_blocks, 1).alias("candidate_block"), all_of(query_blocks).alias("query_block"))
    wanted = asking.select("id", "vector", "mark", F.lit(True).alias("asks"), all_of(candidate_blocks).alias("candidate_block"), F.pmod(F.xxhash64("id", "mark"), F.lit(query_blocks)).cast("int").alias("query_block"))

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        width = int(max(group.column("vector").combine_chunks().value_lengths().to_pylist(), default=0))
        ids = group.column("id").to_numpy()
        matrix = _matrix(group.column("vector"), width, scale)
        by_id = np.argsort(ids[~asks], kind="stable")
        candidate_ids, candidates = ids[~asks][by_id], matrix[~asks][by_id]
        queries, query_ids = matrix[asks], ids[asks]
        found = threshold_top(queries, query_ids, candidates, candidate_ids, k) if len(queries) and len(candidates) else []
        marks = group.column("mark").filter(group.column("asks")).to_pylist()
        most, least = (1 << 63) - 1, -(1 << 63)
        return pa.table(
            {
                "query_id": pa.array([int(query_ids[n]) for n, _, _ in found], pa.int64()),
                "mark": pa.array([marks[n] for n, _, _ in found], pa.int64()),
                "id": pa.array([int(candidate_ids[c]) for _, c, _ in found], pa.int64()),
                "score": pa.array([max(least, min(most, s)) for _, _, s in found], pa.int64()),
            }
        )

    tops = offered.unionByName(wanted).groupBy("candidate_block", "query_block").applyInArrow(run, "query_id long, mark long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "id"))
    return tops.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
