"""Whitening of vectors on their principal components, which come from QDWH spectral divide and conquer.

The vectors are quantised to whole numbers. One pass sums them, a second sums the products of their entries less the rounded
means, all as exact whole numbers, so that the covariance does not depend on how rows are dealt out to tasks. The covariance is
split in one task: the polar factor of the matrix less a shift, found by QR-based dynamically weighted Halley steps, gives the
projector onto the eigenvectors above the shift; an orthonormal basis of its range and one of its complement make two smaller
problems, and so on. Only the side that holds wanted components is split further. A third pass measures how far the covariance
of the whitened rows is from the identity, a fourth gives the rows.

The driver, every task and every plan hold a few d x d or d x components matrices for vectors of d entries, and nothing that
grows with the rows. A task sends one row per pair of dimensions, and Spark adds those up.

Defined results: vectors that are null or hold null or non-finite entries take no part; a vector shorter than others has zeros
behind its end, so an empty one is all zeros; entries beyond 2**30 count as 2**30, whatever their sign keeps; rows of null or
equal id are rows like others; equal eigenvalues share any orthonormal basis of their space; components whose variance is below
1e-11 of the largest are left out, as doubles cannot tell them from none, so equal vectors alone, or one vector, give no rows;
a deviation beyond 64 bits is cut to the largest long; an empty table gives none. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.topk import usable

EPS = float(np.finfo(float).eps)
LARGEST_ENTRY = float(1 << 30)
HALF = 20  # Products of whole numbers below 2**21 are summed as doubles, 2**11 rows at a time.
EXACT_ROWS = 1 << 11
NO_VARIANCE = 1e-11


def polar_factor(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix by QDWH; None if it is singular to working precision."""
    size = len(a)
    x = a / np.linalg.norm(a)
    try:
        # A lower bound of the smallest singular value.
        low = 1 / (np.linalg.norm(np.linalg.inv(x)) * 1.1)
    except np.linalg.LinAlgError:
        return None
    if not low > 4 * EPS:
        return None
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wide = np.sqrt(1 + d)
        first = wide + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * wide))) / 2
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        if third > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(third) * x, np.eye(size)]))
            step = (first - second / third) / np.sqrt(third) * q[:size] @ q[size:].T
        else:
            z = np.eye(size) + third * x.T @ x
            step = (first - second / third) * np.linalg.solve(z, x.T).T
        new = second / third * x + step
        new = (new + new.T) / 2
        low = min(1.0, low * (first + second * low * low) / (1 + third * low * low))
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 10 * EPS and moved < 1e-9 * np.sqrt(size):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if the matrix is a multiple of the identity."""
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= 4 * size * EPS * scale:
        return None
    draw = np.random.default_rng(size)
    best = None
    # The median of the diagonal halves the problem; the mean always lies inside the spectrum; the others avoid an eigenvalue.
    shifts = [float(np.median(np.diag(a))), mean, *(mean + spread / size * draw.uniform(-0.5, 0.5, 8))]
    for shift in shifts:
        factor = polar_factor(a - shift * np.eye(size))
        if factor is None:
            continue
        above = (factor + np.eye(size)) / 2
        rank = int(round(np.trace(above)))
        if not 0 < rank < size:
            continue
        mixed = draw.standard_normal((size, size))
        basis, _ = np.linalg.qr(np.hstack([above @ mixed[:, :rank], mixed[:, rank:] - above @ mixed[:, rank:]]))
        # A second multiplication removes what rounding left of the other side.
        basis, _ = np.linalg.qr(np.hstack([above @ basis[:, :rank], basis[:, rank:] - above @ basis[:, rank:]]))
        upper, lower = basis[:, :rank], basis[:, rank:]
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= 8 * size * EPS * scale:
            break
    return None if best is None else best[1:]


def principal_components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their eigenvectors as columns."""
    scale = float(np.linalg.norm(a))

    def solve(matrix: np.ndarray, basis: np.ndarray, count: int) -> list[np.ndarray]:
        size = len(matrix)
        if size == 1:
            return [basis]
        parts = _split(matrix, scale)
        if parts is None:
            return [basis[:, :count]]
        upper, lower = parts
        out = solve(_symmetric(upper.T @ matrix @ upper), basis @ upper, count)
        found = upper.shape[1]
        if found < count:
            out += solve(_symmetric(lower.T @ matrix @ lower), basis @ lower, count - found)
        return out

    count = min(wanted, len(a))
    if not count or not scale:
        return np.zeros(count), np.eye(len(a))[:, :count]
    vectors = np.hstack(solve(_symmetric(a), np.eye(len(a)), count))[:, :count]
    vectors, upper = np.linalg.qr(vectors)
    vectors *= np.where(np.diag(upper) < 0, -1.0, 1.0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    # Either sign would do; the largest entry is made positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)])
    return values[order], vectors * np.where(signs == 0, 1.0, signs)


def _components_in_task(spark: SparkSession, covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """``principal_components`` of one matrix, in a task, where numpy keeps to the task's cores."""
    width = len(covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                values, basis = principal_components(np.frombuffer(raw).reshape(width, width), components)
                columns = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (values, basis)]
                yield pa.RecordBatch.from_arrays(columns, ["lengths", "basis"])

    one = spark.createDataFrame([(bytearray(np.ascontiguousarray(covariance).tobytes()),)], "matrix binary")
    row = one.mapInArrow(run, "lengths binary, basis binary").first()
    values = np.frombuffer(bytes(row["lengths"]))
    return values, np.frombuffer(bytes(row["basis"])).reshape(width, len(values))


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _quantised(column: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    """Vectors as rows of whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(sizes), width), shift, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.floor(np.clip(values, -LARGEST_ENTRY, LARGEST_ENTRY) * scale).astype(np.int64) + shift
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def _products(y: np.ndarray) -> np.ndarray:
    """y'y as exact whole numbers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    high = np.right_shift(y + (1 << (HALF - 1)), HALF)
    large = bool(high.any())
    for at in range(0, len(y), EXACT_ROWS):
        top = high[at : at + EXACT_ROWS].astype(float)
        low = y[at : at + EXACT_ROWS] - (high[at : at + EXACT_ROWS] << HALF) if large else y[at : at + EXACT_ROWS]
        low = low.astype(float)
        total += (low.T @ low).astype(np.int64)
        if large:
            cross = (top.T @ low).astype(np.int64).astype(object)
            # The upper part is below 2**22, so that its products need fewer rows at a time.
            for near in range(0, len(top), 256):
                total += (top[near : near + 256].T @ top[near : near + 256]).astype(np.int64).astype(object) << (2 * HALF)
            total += (cross + cross.T) << HALF
    return total


def _summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    rows = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    return {(r["i"], r["j"]): int(r["value"]) for r in rows}


CELLS = "i int, j int, value decimal(38,0)"


def _cells(i: np.ndarray, j: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    whole = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), whole], ["i", "j", "value"])


def _sums(rows: DataFrame, width: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sums of their quantised entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = _quantised(batch.column(0), width, scale, shift)
            n += len(x)
            total += x.sum(axis=0)
        if n:
            yield _cells(np.arange(-1, width), np.zeros(width + 1), np.append(np.array([n], object), total))

    cells = _summed(rows.select("vector").mapInArrow(run, CELLS))
    return cells.get((-1, 0), 0), [cells.get((i, 0), 0) for i in range(width)]


def _covariance(rows: DataFrame, n: int, sums: list[int], centre: np.ndarray, width: int, scale: int, shift: int) -> np.ndarray:
    """The covariance of the quantised rows, divisor n; products are taken of entries less ``centre``."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = None, [], 0
        for batch in batches:
            held.append(_quantised(batch.column(0), width, scale, shift) - centre)
            waiting += len(held[-1])
            if waiting >= EXACT_ROWS:
                part = _products(np.concatenate(held))
                total, held, waiting = part if total is None else total + part, [], 0
        if held:
            part = _products(np.concatenate(held))
            total = part if total is None else total + part
        if total is not None:
            yield _cells(*upper, total[upper])

    cells = _summed(rows.select("vector").mapInArrow(run, CELLS))
    # What the rounded means leave over is taken off exactly: n * products - sums * sums, over n * n.
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    out = np.zeros((width, width))
    for (i, j), value in cells.items():
        out[i, j] = out[j, i] = (n * value - rest[i] * rest[j]) / (n * n)
    return out


def _identity_error(rows: DataFrame, projected, components: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity."""
    upper = np.triu_indices(components)
    size = len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white = projected(batch.column(0))[1]
            if not len(white):
                continue
            mean = white.mean(axis=0)
            off = white - mean
            inside, n = off.T @ off, len(white)
            # Rows centred on their own mean, and the means' part, are added up apart.
            values = np.concatenate([[n], n * mean, inside[upper], (n * np.outer(mean, mean))[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "value"])

    found = rows.select("vector").mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
    value = np.zeros(1 + components + 2 * size)
    for r in found:
        value[r["i"]] = r["value"]
    n, mean = value[0], value[1 : 1 + components] / value[0]
    covariance = (value[1 + components : 1 + components + size] + value[1 + components + size :]) / n - np.outer(mean, mean)[upper]
    return float(np.abs(covariance - (upper[0] == upper[1])).max())


def whitened(
    vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row. Runs four jobs before that."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    nothing = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    n, sums = _sums(rows, width, scale, shift)
    if not n or not width:
        return nothing
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    covariance = _covariance(rows, n, sums, centre, width, scale, shift)
    values, basis = _components_in_task(vectors.sparkSession, covariance, components)
    kept = (values > NO_VARIANCE * values[:1].max(initial=0)) & (values > 0)
    values, basis = values[kept], basis[:, kept]
    count = len(values)
    if not count:
        return nothing
    weights = basis / np.sqrt(values)
    explained = values / np.trace(covariance)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], object)
    mean = np.array([int(r) / n for r in rest])

    def projected(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        y = _quantised(column, width, scale, shift) - centre
        return y, (y - mean) @ weights

    error = _identity_error(rows, projected, count)
    largest_rest = max(abs(int(r)) for r in rest)

    def deviations(y: np.ndarray) -> np.ndarray:
        most = n * int(np.abs(y).max(initial=0)) + largest_rest
        if most * most * width < 1 << 63:
            return ((n * y - rest.astype(np.int64)) ** 2).sum(axis=1)
        exact = ((n * y.astype(object) - rest) ** 2).sum(axis=1)
        return np.array([min(int(v), (1 << 63) - 1) for v in exact], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, white = projected(batch.column(1))
            size = len(y)
            place = pa.array(np.repeat(np.arange(size), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(place),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, n, np.int64)),
                    pa.array(np.repeat(deviations(y), count)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * count, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
