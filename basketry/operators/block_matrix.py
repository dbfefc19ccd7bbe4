"""Symmetric positive definite matrices in square blocks: Cholesky factor, inverse, and sparse rows times dense columns.

A matrix is a stored table with one row per block that is not all zero. The factor is found column by column and its inverse row by row;
a round reads what earlier rounds wrote and writes its own blocks once, so nothing is rewritten. Only the lower triangle is kept.
Sums of block products are cut into strips of ``STRIP`` blocks, which are added up once more: a task holds at most
2 * STRIP + 1 blocks, or one block per strip. The driver passes on one diagonal block at a time.

Tables of finished steps are deleted as soon as what was made from them is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.blocks import DIGITS, best_per_row
from basketry.operators.distributed import top_rows
from basketry.runtime import delete_scratch, require_positive, scratch_path

BLOCKS = "bi int, bj int, rows int, data binary"
STRIP = 16
# Bytes of dense columns, and of a user's share of products, that a task of a multiplication may hold.
TASK_BYTES = 64 << 20
# Entries of sparse rows in one block of rows.
ENTRIES = 1 << 20
TILE = 256


def dense(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1)


def _row(bi: int, bj: int, block: np.ndarray) -> dict:
    return {"bi": bi, "bj": bj, "rows": len(block), "data": np.ascontiguousarray(block).tobytes()}


SCHEMA = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("rows", pa.int32()), ("data", pa.binary())])


def _rows(found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([f for f in found if any(f["data"])], SCHEMA)


@dataclass
class BlockMatrix:
    """The lower triangle of a symmetric matrix of ``size`` rows, stored at ``path``."""

    spark: SparkSession
    path: str
    size: int
    block: int

    @property
    def count(self) -> int:
        return -(-self.size // self.block)

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(self.path)

    def delete(self) -> None:
        delete_scratch(self.spark, self.path)

    def full(self) -> DataFrame:
        """Both triangles."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    turned = [_row(r["bj"], r["bi"], dense(r["data"], r["rows"]).T)] if r["bi"] != r["bj"] else []
                    for one in [r, *turned]:
                        yield pa.RecordBatch.from_pylist([one], SCHEMA)

        return self.blocks.mapInArrow(run, BLOCKS)


def lower_blocks(cells: DataFrame, size: int, shift: float, block: int) -> BlockMatrix:
    """``cells`` (i, j, value), given at least for i >= j, plus ``shift`` on the diagonal, as stored blocks."""
    require_positive(block=block)
    spark = cells.sparkSession
    lower = cells.filter(F.col("i") >= F.col("j"))
    placed = lower.select(
        F.floor(F.col("i") / block).cast("int").alias("bi"), F.floor(F.col("j") / block).cast("int").alias("bj"),
        (F.col("i") % block).cast("int").alias("r"), (F.col("j") % block).cast("int").alias("c"), F.col("value").cast("double").alias("value"),
    )
    diagonal = spark.range(size).select(
        F.floor(F.col("id") / block).cast("int").alias("bi"), F.floor(F.col("id") / block).cast("int").alias("bj"),
        (F.col("id") % block).cast("int").alias("r"), (F.col("id") % block).cast("int").alias("c"), F.lit(float(shift)).alias("value"),
    )

    def fill(group: pa.Table) -> pa.Table:
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        out = np.zeros((min(block, size - bi * block), min(block, size - bj * block)))
        np.add.at(out, (group.column("r").to_numpy(), group.column("c").to_numpy()), group.column("value").to_numpy())
        if bi == bj:
            out = np.tril(out) + np.tril(out, -1).T
        return _rows([_row(bi, bj, out)])

    path = scratch_path(spark, "blocks")
    placed.unionByName(diagonal).groupBy("bi", "bj").applyInArrow(fill, BLOCKS).write.parquet(path)
    return BlockMatrix(spark, path, size, block)


def _products(left: DataFrame, right: DataFrame, multiply: Callable[[np.ndarray, np.ndarray], np.ndarray], strip: int) -> DataFrame:
    """Sums over ``k`` of products of blocks ``(bi, bj, k, rows, data)`` that share (bi, bj, k), in strips: one block per strip."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def run(group: pa.Table) -> pa.Table:
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        order = sorted(range(len(group)), key=lambda n: group.column("k")[n].as_py())
        sides: tuple[dict, dict] = ({}, {})
        for n in order:
            k = group.column("k")[n].as_py()
            sides[group.column("side")[n].as_py()][k] = dense(group.column("data")[n].as_py(), group.column("rows")[n].as_py())
        total = None
        for k, block in sides[0].items():
            if k in sides[1]:
                part = multiply(block, sides[1][k])
                total = part if total is None else total + part
        return _rows([] if total is None else [_row(bi, bj, total)])

    return both.withColumn("strip", F.floor(F.col("k") / strip)).groupBy("bi", "bj", "strip").applyInArrow(run, BLOCKS)


def _total(parts: DataFrame, minus: DataFrame | None, finish: Callable[[int, int, np.ndarray], np.ndarray] = lambda bi, bj, x: x) -> DataFrame:
    """``parts`` added up, less the blocks of ``minus``, then ``finish``\\ ed."""
    signed = parts.withColumn("sign", F.lit(1.0))
    if minus is not None:
        signed = signed.unionByName(minus.withColumn("sign", F.lit(-1.0)))

    def run(group: pa.Table) -> pa.Table:
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        total = 0.0
        for n in range(len(group)):
            total = total + group.column("sign")[n].as_py() * dense(group.column("data")[n].as_py(), group.column("rows")[n].as_py())
        return _rows([_row(bi, bj, finish(bi, bj, total))])

    return signed.groupBy("bi", "bj").applyInArrow(run, BLOCKS)


def _between(low: Column | int, high: Column | int) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.explode(F.sequence(as_column(low).cast("int"), as_column(high).cast("int")))


def _at(table: DataFrame, bi: Column, bj: Column, k: Column) -> DataFrame:
    return table.select(bi.alias("bi"), bj.alias("bj"), k.alias("k"), "rows", "data")


def _one(table: DataFrame, bi: int, bj: int) -> np.ndarray:
    r = table.filter((F.col("bi") == bi) & (F.col("bj") == bj)).first()
    return dense(bytes(r["data"]), r["rows"])


def _inverted_factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inverse of the Cholesky factor of a diagonal block; done in a task, where numpy keeps to the task's cores."""
    for batch in batches:
        for r in batch.to_pylist():
            whole = dense(r["data"], r["rows"])
            try:
                factor = np.linalg.cholesky(whole)
            except np.linalg.LinAlgError as error:
                raise ValueError("the matrix is not positive definite") from error
            yield pa.RecordBatch.from_pylist([_row(r["bi"], r["bj"], np.linalg.inv(factor))], SCHEMA)


def cholesky(matrix: BlockMatrix, strip: int = STRIP) -> BlockMatrix:
    """The lower factor L of A = L Lᵀ; its diagonal blocks are stored inverted, as that is all they are used for."""
    spark, count = matrix.spark, matrix.count
    out = BlockMatrix(spark, scratch_path(spark, "factor"), matrix.size, matrix.block)
    for p in range(count):
        column = matrix.blocks.filter((F.col("bj") == p) & (F.col("bi") >= p))
        raw = scratch_path(spark, "column")
        if p:
            known = out.blocks.filter(F.col("bj") < p)
            left = _at(known.filter(F.col("bi") >= p), F.col("bi"), F.lit(p), F.col("bj"))
            right = _at(known.filter(F.col("bi") == p), _between(p, count - 1), F.lit(p), F.col("bj"))
            column = _total(column, _products(left, right, lambda x, y: x @ y.T, strip))
        column.write.parquet(raw)
        column = spark.read.schema(BLOCKS).parquet(raw)
        pivot = _one(column.filter(F.col("bi") == p).mapInArrow(_inverted_factor, BLOCKS), p, p)

        def divide(batches: Iterator[pa.RecordBatch], pivot: np.ndarray = pivot, p: int = p) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    new = pivot if r["bi"] == p else dense(r["data"], r["rows"]) @ pivot.T
                    yield pa.RecordBatch.from_pylist([_row(r["bi"], p, new)], SCHEMA)

        column.mapInArrow(divide, BLOCKS).write.mode("append").parquet(out.path)
        delete_scratch(spark, raw)
    return out


def inverse(matrix: BlockMatrix, strip: int = STRIP) -> BlockMatrix:
    """The inverse of a symmetric positive definite matrix; fails if it is not definite."""
    spark, count = matrix.spark, matrix.count
    factor = cholesky(matrix, strip)
    # Rows of M, the inverse of L: M_ij = -inv(L_ii) * sum over j <= k < i of L_ik M_kj.
    lower = BlockMatrix(spark, scratch_path(spark, "factor-inverse"), matrix.size, matrix.block)
    factor.blocks.filter("bi = bj").write.parquet(lower.path)
    for i in range(1, count):
        left = factor.blocks.filter((F.col("bi") == i) & (F.col("bj") < i))
        if not left.take(1):
            continue
        centre = _one(factor.blocks, i, i)
        right = lower.blocks.filter(F.col("bi") < i)
        parts = _products(
            _at(left, F.lit(i), _between(0, F.col("bj")), F.col("bj")), _at(right, F.lit(i), F.col("bj"), F.col("bi")), lambda x, y: x @ y, strip
        )
        # A row is written before it is added, as it is made from the table that it goes into.
        raw = scratch_path(spark, "row")
        _total(parts, None, lambda bi, bj, x, centre=centre: -(centre @ x)).write.parquet(raw)
        spark.read.schema(BLOCKS).parquet(raw).write.mode("append").parquet(lower.path)
        delete_scratch(spark, raw)
    factor.delete()
    # The inverse is Mᵀ M: its block (i, j) is the sum over k >= i of the products of M's blocks (k, i) and (k, j), for i >= j.
    m = lower.blocks
    left = _at(m, F.col("bj"), _between(0, F.col("bj")), F.col("bi"))
    right = _at(m, _between(F.col("bj"), F.col("bi")), F.col("bj"), F.col("bi"))
    out = BlockMatrix(spark, scratch_path(spark, "inverse"), matrix.size, matrix.block)
    _total(_products(left, right, lambda x, y: x.T @ y, strip), None).write.parquet(out.path)
    lower.delete()
    return out


def diagonal(matrix: BlockMatrix) -> DataFrame:
    """``(i, value)`` of the diagonal."""
    block = matrix.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = np.diagonal(dense(r["data"], r["rows"]))
                yield pa.RecordBatch.from_arrays([pa.array(r["bi"] * block + np.arange(len(values))), pa.array(values)], ["i", "value"])

    return matrix.blocks.filter("bi = bj").mapInArrow(run, "i long, value double")


def column_width(size: int, block: int) -> int:
    """How many columns of a dense matrix of ``size`` rows fit into a task's bytes; one at least."""
    return max(1, min(block, TASK_BYTES // (8 * max(1, size))))


def sparse_times_dense(rows: DataFrame, matrix: DataFrame, size: int, block: int, n: int, filter_seen: bool = False) -> DataFrame:
    """Best ``n`` columns of each sparse row times a dense matrix: ``(row_id, j, score, rank)``.

    ``rows`` is ``(row_id, i, w)``, stored; ``matrix`` holds blocks ``(bi, bj, rows, data)`` of ``block`` rows and columns. Rows are dealt into
    blocks by their number of entries, columns into strips that fit into ``TASK_BYTES``; a task adds up, block by block of the middle
    dimension, what its rows get from its strip, and hands on the best ``n`` of each row. Cells that are zero are no votes; a column
    without a vote is no result, nor with ``filter_seen`` one of the row's own. Runs a count.
    """
    require_positive(n=n, block=block)
    width = column_width(size, block)
    strips_of_block = -(-block // width)
    strips = -(-size // block) * strips_of_block
    deals = max(1, -(-rows.count() // ENTRIES))
    kind = rows.schema["row_id"].dataType.simpleString()
    deal = F.pmod(F.xxhash64("row_id"), F.lit(deals)).cast("int")
    none = {"row_id": F.lit(None).cast(kind), "i": F.lit(None).cast("long"), "w": F.lit(None).cast("double"), "bi": F.lit(None).cast("int"), "rows": F.lit(None).cast("int"), "data": F.lit(None).cast("binary")}
    asked = rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else none[c].alias(c) for c, t in (("row_id", kind), ("i", "long"), ("w", "double"), ("bi", "int"), ("rows", "int"), ("data", "binary"))), deal.alias("deal"), _between(0, strips - 1).alias("strip"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                whole = dense(r["data"], r["rows"])
                for part in range(strips_of_block):
                    piece = whole[:, part * width : (part + 1) * width]
                    if piece.any():
                        yield pa.RecordBatch.from_pylist([_row(r["bi"], r["bj"] * strips_of_block + part, piece)], SCHEMA)

    pieces = matrix.mapInArrow(cut_up, BLOCKS)
    given = pieces.select(none["row_id"].alias("row_id"), none["i"].alias("i"), none["w"].alias("w"), "bi", "rows", "data", _between(0, deals - 1).alias("deal"), F.col("bj").alias("strip"))

    def run(group: pa.Table) -> pa.Table:
        is_row = np.array(group.column("data").is_null())
        mine, blocks = group.filter(pa.array(is_row)), group.filter(pa.array(~is_row))
        empty = pa.table({"row_id": group.column("row_id").slice(0, 0), "j": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(mine) or not len(blocks):
            return empty
        strip = group.column("strip")[0].as_py()
        first_column = strip // strips_of_block * block + strip % strips_of_block * width
        ids = mine.column("row_id").to_numpy()
        names, owner = np.unique(ids, return_inverse=True)
        i, w = mine.column("i").to_numpy().astype(np.int64), mine.column("w").to_numpy().astype(float)
        order = np.lexsort((i, owner))
        owner, i, w = owner[order], i[order], w[order]
        at_row = {blocks.column("bi")[k].as_py(): k for k in range(len(blocks))}
        columns = len(blocks.column("data")[0].as_py()) // 8 // blocks.column("rows")[0].as_py()
        found: list[pa.Table] = []
        bounds = np.searchsorted(owner, np.arange(0, len(names) + TILE, TILE))
        for tile, (first, end) in enumerate(zip(bounds[:-1], bounds[1:])):
            low = tile * TILE
            high = min(low + TILE, len(names))
            scores, votes = np.zeros((high - low, columns)), np.zeros((high - low, columns), bool)
            o, here, weight = owner[first:end] - low, i[first:end], w[first:end]
            for bi in np.unique(here // block):
                if int(bi) not in at_row:
                    continue
                k = at_row[int(bi)]
                part = dense(blocks.column("data")[k].as_py(), blocks.column("rows")[k].as_py())
                some = np.flatnonzero(here // block == bi)
                # So many entries at a time that their rows fit into a task's bytes too.
                step = max(1, TASK_BYTES // (8 * columns))
                for a in range(0, len(some), step):
                    e = some[a : a + step]
                    picked = part[here[e] - bi * block]
                    edges = np.flatnonzero(np.append(True, o[e][1:] != o[e][:-1]))
                    scores[o[e][edges]] += np.add.reduceat(picked * weight[e, None], edges, axis=0)
                    votes[o[e][edges]] |= np.logical_or.reduceat(picked != 0, edges, axis=0)
            scores = np.where(votes, np.round(scores, DIGITS), -np.inf)
            if filter_seen:
                own = (here >= first_column) & (here < first_column + columns)
                scores[o[own], here[own] - first_column] = -np.inf
            r, c = best_per_row(scores, n, None)
            found.append(pa.table({"row_id": pa.array(names[low + r], group.schema.field("row_id").type), "j": pa.array(first_column + c), "score": pa.array(scores[r, c])}))
        return pa.concat_tables([empty, *found])

    best = asked.unionByName(given).groupBy("deal", "strip").applyInArrow(run, f"row_id {kind}, j long, score double")
    return top_rows(best, ["row_id"], [F.desc("score"), F.asc("j")], n)
