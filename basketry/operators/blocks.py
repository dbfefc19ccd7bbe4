"""Best partners by inner product, block against block.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is one task: it adds up products, masks
excluded pairs, keeps the best ``n`` per query and drops the rest. A vector is sent once to every block of the other side;
no pairs are shuffled but the ``n`` best of each block. The same plan serves every size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.distributed import sorted_index, top_rows
from basketry.runtime import cut, require_positive, union_all

DIGITS = 9
TILE = 256
# Products that are added up at once.
CHUNK = 4_000_000
BLOCK = 8192
# Vectors may be long: a block of sparse vectors has about so many entries at most.
ENTRIES = 4_000_000
# Cells of the dense form of one side of a task.
CELLS = 8_000_000
# Parts that each side of a search is dealt into, and vectors in a part at most.
TASKS, MOST = 16, 32_768
# Scores of a block that give a first bound for a query's best ones.
LOOK = 4096
QUERY, CANDIDATE, EXCLUDED = 0, 1, 2


def block_count(ids: DataFrame, column: str, block: int, entries: int | None = None) -> int:
    """How many blocks hold about ``block`` ids and, if given, about ``entries`` rows each."""
    n, rows = ids.agg(F.countDistinct(column), F.count(F.lit(1))).first()
    return max(1, -(-n // block), -(-rows // entries) if entries else 1)


def best_per_row(scores: np.ndarray, n: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best ``n`` scores of each row; ties go to the smaller column.

    Scores that are not above ``least``, or minus infinity, are left out.
    """
    wanted = scores > (-np.inf if least is None else least)
    if scores.shape[1] > n:
        wanted &= scores >= np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n, None]
    rows, columns = np.nonzero(wanted)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < n
    return rows[kept], columns[kept]


def best_above(scores: np.ndarray, n: int, least: float | None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_per_row``, with the scores rounded, for scores that are not rounded yet.

    ``floor`` says what a row's score must reach to matter; without it the first columns do. The many scores below it are looked at once.
    """
    floor = np.full(len(scores), -np.inf) if floor is None else floor
    width, open_ = min(scores.shape[1], max(LOOK, 4 * n)), floor == -np.inf
    if width > n and open_.any():
        floor = np.where(open_, np.partition(scores[:, :width], width - n, axis=1)[:, width - n], floor)
    # Scores are rounded to nine places after this.
    bound = floor - 2e-9 if least is None else np.maximum(floor - 2e-9, least + 4e-10)
    rows, columns = np.divmod(np.flatnonzero(scores >= bound[:, None]), scores.shape[1])
    found = np.round(scores[rows, columns], DIGITS)
    wanted = found > (-np.inf if least is None else least)
    rows, columns, found = rows[wanted], columns[wanted], found[wanted]
    order = np.lexsort((columns, -found, rows))
    rows, columns, found = rows[order], columns[order], found[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
    return rows[kept], columns[kept], found[kept]


def _floors(queries: pa.Table, at: np.ndarray, size: int) -> np.ndarray | None:
    """What each query's score must reach, if the rows say so."""
    if "floor" not in queries.column_names:
        return None
    out = np.full(size, -np.inf)
    out[at] = np.nan_to_num(_values(queries, "floor"), nan=-np.inf)
    return out


def _values(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _dealt(df: DataFrame, kind: int, columns: dict[str, Column], mine: str, mine_n: int, other: str, other_n: int) -> DataFrame:
    """Rows for every block of the other side; excluded pairs go to the one pair of blocks that has both."""
    block = lambda key, n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    key = {"_q": "query_id", "_c": "candidate_id"}
    second = block(key[other], other_n) if kind == EXCLUDED else F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
    return df.select(F.lit(kind).alias("kind"), *(c.alias(n) for n, c in columns.items()), block(key[mine], mine_n).alias(mine), second.alias(other))


def _blocks_of(parts: list[DataFrame], task: Callable[[pa.Table], pa.Table], n: int) -> DataFrame:
    rows = union_all([p.select(*parts[0].columns) for p in parts])
    kinds = [parts[0].schema[c].dataType.simpleString() for c in ("query_id", "candidate_id")]
    partial = rows.groupBy("_q", "_c").applyInArrow(task, f"query_id {kinds[0]}, candidate_id {kinds[1]}, score double")
    return top_rows(partial, ["query_id"], [F.desc("score"), F.asc("candidate_id")], n)


def _found(queries: list, candidates: list, scores: list, schema: pa.Schema) -> pa.Table:
    columns = [np.concatenate(x) if x else np.zeros(0) for x in (queries, candidates, scores)]
    kinds = [schema.field("query_id").type, schema.field("candidate_id").type, pa.float64()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("query_id", "candidate_id", "score"), columns, kinds)})


def _masks(excluded: pa.Table, queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the excluded pairs, by query."""
    q, c = _values(excluded, "query_id"), _values(excluded, "candidate_id")
    at, to = np.searchsorted(queries, q), np.searchsorted(candidates, c)
    known = (at < len(queries)) & (to < len(candidates))
    at, to, q, c = at[known], to[known], q[known], c[known]
    same = (queries[at] == q) & (candidates[to] == c)
    order = np.argsort(at[same], kind="stable")
    return at[same][order], to[same][order]


def sparse_task(n: int, least: float | None) -> Callable[[pa.Table], pa.Table]:
    """What a task does with queries, candidates and excluded pairs ``(kind, query_id, candidate_id, dim, w)``: the best ``n`` of each query."""

    def task(group: pa.Table) -> pa.Table:
        kind = _values(group, "kind")
        q, c, x = (group.filter(pa.array(kind == k)) for k in (QUERY, CANDIDATE, EXCLUDED))
        out: tuple[list, list, list] = ([], [], [])
        if not len(q) or not len(c):
            return _found(*out, group.schema)
        q_ids, q_at = np.unique(_values(q, "query_id"), return_inverse=True)
        c_ids, c_at = np.unique(_values(c, "candidate_id"), return_inverse=True)
        dims, place = np.unique(np.concatenate([_values(q, "dim"), _values(c, "dim")]), return_inverse=True)
        q_dim, c_dim = place[: len(q)], place[len(q) :]
        by_dim = np.argsort(c_dim, kind="stable")
        c_at, c_w = c_at[by_dim], _values(c, "w")[by_dim]
        begin = np.searchsorted(c_dim[by_dim], np.arange(len(dims) + 1))
        by_query = np.lexsort((q_dim, q_at))
        q_at, q_dim, q_w = q_at[by_query], q_dim[by_query], _values(q, "w")[by_query]
        length = begin[q_dim + 1] - begin[q_dim]
        x_at, x_to = _masks(x, q_ids, c_ids)
        width = len(c_ids)
        # A matrix product looks at all dimensions of a pair, but is some hundred times faster for each. Pairs without a
        # common dimension get zero from it, which only a bound of zero or more leaves out.
        cells = len(q_ids) * width * (len(dims) + 20)
        if least is not None and least >= 0 and width * len(dims) <= CELLS and cells <= 300 * int(length.sum()):
            floor = _floors(q, np.unique(_values(q, "query_id"), return_inverse=True)[1], len(q_ids))
            right = np.bincount(c_dim[by_dim] * width + c_at, c_w, len(dims) * width).reshape(len(dims), width)
            for low in range(0, len(q_ids), TILE):
                high = min(low + TILE, len(q_ids))
                first, end = np.searchsorted(q_at, [low, high])
                left = np.bincount((q_at[first:end] - low) * len(dims) + q_dim[first:end], q_w[first:end], (high - low) * len(dims))
                scores = left.reshape(-1, len(dims)) @ right
                hidden = slice(*np.searchsorted(x_at, [low, high]))
                scores[x_at[hidden] - low, x_to[hidden]] = -np.inf
                rows, columns, found = best_above(scores, n, least, None if floor is None else floor[low:high])
                for target, part in zip(out, (q_ids[low + rows], c_ids[columns], found)):
                    target.append(part)
            return _found(*out, group.schema)
        for low in range(0, len(q_ids), TILE):
            high = min(low + TILE, len(q_ids))
            scores = np.zeros((high - low) * width)
            met = np.zeros((high - low) * width, bool)
            first, end = np.searchsorted(q_at, [low, high])
            while first < end:
                sums = np.cumsum(length[first:end])
                last = first + max(1, int(np.searchsorted(sums, CHUNK, side="right")))
                size = length[first:last]
                total = int(size.sum())
                entry = np.repeat(np.arange(first, last), size)
                at = begin[q_dim[entry]] + np.arange(total) - np.repeat(np.cumsum(size) - size, size)
                cell = (q_at[entry] - low) * width + c_at[at]
                scores += np.bincount(cell, q_w[entry] * c_w[at], len(scores))
                met[cell] = True
                first = last
            scores = np.where(met, np.round(scores, DIGITS), -np.inf).reshape(-1, width)
            hidden = slice(*np.searchsorted(x_at, [low, high]))
            scores[x_at[hidden] - low, x_to[hidden]] = -np.inf
            rows, columns = best_per_row(scores, n, least)
            for target, part in zip(out, (q_ids[low + rows], c_ids[columns], scores[rows, columns])):
                target.append(part)
        return _found(*out, group.schema)

    return task


def sparse_top(
    queries: DataFrame, candidates: DataFrame, n: int, exclude: DataFrame | None = None, block: int = BLOCK, least: float | None = 0.0
) -> DataFrame:
    """Best ``n`` candidates of each query: ``(query_id, candidate_id, score, rank)``.

    ``queries`` is ``(query_id, dim, w)`` and ``candidates`` is ``(candidate_id, dim, w)``, both stored; ``exclude`` lists
    pairs. Only pairs with a common dimension and a score above ``least`` count. Runs two counts.
    """
    require_positive(n=n, block=block)
    q_blocks, c_blocks = block_count(queries, "query_id", block, ENTRIES), block_count(candidates, "candidate_id", block, ENTRIES)
    q_kind, c_kind = queries.schema["query_id"].dataType, candidates.schema["candidate_id"].dataType
    nothing = {"dim": F.lit(None).cast(queries.schema["dim"].dataType), "w": F.lit(None).cast("double")}
    weights = {"dim": F.col("dim"), "w": F.col("w").cast("double")}
    no_query, no_candidate = {"query_id": F.lit(None).cast(q_kind)}, {"candidate_id": F.lit(None).cast(c_kind)}
    parts = [
        _dealt(queries, QUERY, {"query_id": F.col("query_id"), **no_candidate, **weights}, "_q", q_blocks, "_c", c_blocks),
        _dealt(candidates, CANDIDATE, {**no_query, "candidate_id": F.col("candidate_id"), **weights}, "_c", c_blocks, "_q", q_blocks),
    ]
    if exclude is not None:
        parts.append(_dealt(exclude, EXCLUDED, {"query_id": F.col("query_id"), "candidate_id": F.col("candidate_id"), **nothing}, "_q", q_blocks, "_c", c_blocks))

    return _blocks_of(parts, sparse_task(n, least), n)


def dense_task(n: int, tile: int) -> Callable[[pa.Table], pa.Table]:
    """As ``sparse_task`` for ``(kind, query_id, candidate_id, vector)``; every pair counts."""

    def task(group: pa.Table) -> pa.Table:
        kind = _values(group, "kind")
        q, c, x = (group.filter(pa.array(kind == k)) for k in (QUERY, CANDIDATE, EXCLUDED))
        out: tuple[list, list, list] = ([], [], [])
        if not len(q) or not len(c):
            return _found(*out, group.schema)

        def side(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
            ids = _values(table, name)
            order = np.argsort(ids, kind="stable")
            flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return ids[order], flat.reshape(len(ids), -1)[order]

        (q_ids, left), (c_ids, right) = side(q, "query_id"), side(c, "candidate_id")
        x_at, x_to = _masks(x, q_ids, c_ids)
        floor = _floors(q, np.searchsorted(q_ids, _values(q, "query_id")), len(q_ids))
        for low in range(0, len(q_ids), tile):
            high = min(low + tile, len(q_ids))
            scores = left[low:high] @ right.T
            hidden = slice(*np.searchsorted(x_at, [low, high]))
            scores[x_at[hidden] - low, x_to[hidden]] = -np.inf
            rows, columns, found = best_above(scores, n, None, None if floor is None else floor[low:high])
            for target, part in zip(out, (q_ids[low + rows], c_ids[columns], found)):
                target.append(part)
        return _found(*out, group.schema)

    return task


def _lengths(vector: str = "vector") -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def dense_top(queries: DataFrame, candidates: DataFrame, n: int, exclude: DataFrame | None = None, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """As ``sparse_top`` for ``(query_id, vector)`` and ``(candidate_id, vector)`` with vectors of one length; every pair counts.

    Candidates are dealt into blocks from the longest to the shortest. All queries meet the first block; its n-th score says how far down
    the others a query has to go, as no product exceeds the product of the two lengths. A task takes many blocks at once, as every query
    hands on ``n`` candidates from each task that it is sent to; its n-th score so far goes along. Runs counts.
    """
    require_positive(n=n, block=block, tile=tile)
    # Vectors on each side of a task: a sixteenth of them, while they fit into ``CELLS``.
    width = queries.agg(F.max(F.size("vector"))).first()[0] or 1
    most = max(1, min(MOST, CELLS // max(1, width)))
    total = block_count(queries, "query_id", 1)
    q_blocks = max(1, -(-total // max(block, min(most, -(-total // TASKS)))))
    vector = F.col("vector").cast("array<double>")
    asked = queries.select("query_id", vector.alias("vector"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("_q"))
    sized = candidates.select("candidate_id", vector.alias("vector")).withColumn("_length", _lengths())
    placed = cut(sorted_index(sized, [F.desc("_length"), "candidate_id"], "_place").withColumn("_c", F.floor(F.col("_place") / block).cast("int")))
    count = placed.count()
    strip = max(1, min(most, -(-count // TASKS)) // block)
    # One number per block.
    longest = [r[1] for r in placed.groupBy("_c").agg(F.max("_length")).orderBy("_c").collect()]
    q_kind, c_kind = queries.schema["query_id"].dataType, candidates.schema["candidate_id"].dataType
    found = f"query_id {q_kind.simpleString()}, candidate_id {c_kind.simpleString()}, score double"
    no_query, no_candidate, none = F.lit(None).cast(q_kind), F.lit(None).cast(c_kind), F.lit(None).cast("array<double>")
    no_floor = F.lit(None).cast("double")
    columns = lambda kind, q, c, v, floor=no_floor: [F.lit(kind).alias("kind"), q.alias("query_id"), c.alias("candidate_id"), v.alias("vector"), floor.alias("floor"), "_q", "_c"]
    hidden = None if exclude is None else exclude.join(asked.select("query_id", "_q"), "query_id").join(placed.select("candidate_id", "_c"), "candidate_id")

    def met(wanted: DataFrame, placed: DataFrame, hidden: DataFrame | None) -> DataFrame:
        """The best of the pairs of blocks in ``wanted`` (query_id, vector, floor, _q, _c)."""
        pairs = wanted.select("_q", "_c").distinct()
        parts = [
            wanted.select(*columns(QUERY, F.col("query_id"), no_candidate, F.col("vector"), F.col("floor"))),
            placed.join(pairs, "_c").select(*columns(CANDIDATE, no_query, F.col("candidate_id"), F.col("vector"))),
        ]
        if hidden is not None:
            parts.append(hidden.join(wanted.select("query_id", "_c"), ["query_id", "_c"], "left_semi").select(*columns(EXCLUDED, F.col("query_id"), F.col("candidate_id"), none)))
        return union_all(parts).groupBy("_q", "_c").applyInArrow(dense_task(n, tile), found)

    first = met(asked.withColumns({"floor": no_floor, "_c": F.lit(0)}), placed, hidden)
    if len(longest) > 1:
        first = cut(first)
        # Strips of blocks, the first block left out.
        strips = lambda df: df.filter(F.col("_c") > 0).withColumn("_c", F.floor((F.col("_c") - 1) / strip).cast("int"))
        last = F.floor((F.col("_last") - 1) / strip).cast("int")
        reached = last_within_reach(asked, first, longest, n).select("query_id", F.explode(F.sequence(F.lit(0), last)).alias("_c"))
        least = top_rows(first, ["query_id"], [F.desc("score"), F.asc("candidate_id")], n).filter(F.col("rank") == n)
        wanted = asked.join(reached, "query_id").join(least.select("query_id", F.col("score").alias("floor")), "query_id", "left")
        first = first.unionByName(met(wanted, strips(placed), None if hidden is None else strips(hidden)))
    return top_rows(first, ["query_id"], [F.desc("score"), F.asc("candidate_id")], n)


def last_within_reach(asked: DataFrame, first: DataFrame, longest: list[float], n: int) -> DataFrame:
    """``(query_id, _last)``: the last block that may hold one of a query's best ``n``, given those of the first block; none if that is the first."""
    least = top_rows(first, ["query_id"], [F.desc("score"), F.asc("candidate_id")], n).filter(F.col("rank") == n).select("query_id", F.col("score").alias("_least"))
    reach = F.array(*[F.lit(float(x)) for x in longest[1:]])
    # Scores are rounded to nine places, and lengths to doubles.
    near = lambda x: x * F.col("_own") * (1 + 1e-12) + 2e-9 >= F.col("_least")
    last = F.when(F.col("_least").isNull(), F.lit(len(longest) - 1)).otherwise(F.size(F.filter(reach, near)))
    bounded = asked.select("query_id", _lengths().alias("_own")).join(least, "query_id", "left").withColumn("_last", last)
    return bounded.filter(F.col("_last") > 0).select("query_id", "_last")


def blocks_within_reach(asked: DataFrame, first: DataFrame, longest: list[float], n: int) -> DataFrame:
    """``(query_id, _c)``: the blocks after the first up to that one."""
    return last_within_reach(asked, first, longest, n).select("query_id", F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("_c"))
