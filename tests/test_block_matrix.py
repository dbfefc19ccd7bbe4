"""Block matrices against numpy: factor, inverse, products with sparse rows, bounded tasks and deleted files."""

import os

import numpy as np
import pytest

from basketry.operators import block_matrix as M
from basketry.operators import linear
from basketry.runtime import scratch_path


def whole(matrix, lower=True):
    out = np.zeros((matrix.size, matrix.size))
    for r in matrix.blocks.collect():
        part = M.dense(bytes(r.data), r.rows)
        a, b = r.bi * matrix.block, r.bj * matrix.block
        assert r.bi >= r.bj
        out[a : a + part.shape[0], b : b + part.shape[1]] = part
    return out if not lower else np.tril(out) + np.tril(out, -1).T


def cells_of(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, value double")


def scratch_tables(spark):
    folder = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.split("-")[0] in ("blocks", "factor", "column", "row", "inverse")}


@pytest.mark.parametrize("size, block, strip", [(23, 5, 2), (12, 4, 16), (6, 50, 2)])
def test_inverse_equals_numpy(spark, size, block, strip):
    draw = np.random.default_rng(size)
    x = draw.random((40, size)) * (draw.random((40, size)) < 0.3)
    a = x.T @ x
    before = scratch_tables(spark)
    matrix = M.lower_blocks(cells_of(spark, a), size, 2.0, block)
    full = a + 2.0 * np.eye(size)
    assert np.allclose(whole(matrix), full)
    found = M.inverse(matrix, strip)
    assert np.allclose(whole(found), np.linalg.inv(full), atol=1e-10)
    assert np.allclose(full @ whole(found), np.eye(size), atol=1e-9)
    assert found.blocks.count() <= found.count * (found.count + 1) // 2
    matrix.delete()
    # Nothing of the rounds is left but the result.
    assert len(scratch_tables(spark) - before) == 1
    found.delete()
    assert scratch_tables(spark) == before


def test_zero_blocks_are_not_stored(spark):
    a = np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 3.0]]))
    found = M.inverse(M.lower_blocks(cells_of(spark, a), 8, 1.0, 2))
    assert found.blocks.count() == 4 and np.allclose(whole(found), np.linalg.inv(a + np.eye(8)))
    with pytest.raises(Exception, match="not positive definite"):
        M.inverse(M.lower_blocks(cells_of(spark, -a), 8, 0.0, 2))


@pytest.mark.parametrize("seen", [False, True])
def test_sparse_times_dense(spark, monkeypatch, seen):
    draw = np.random.default_rng(5)
    size, users, block = 21, 40, 4
    b = draw.standard_normal((size, size)) * (draw.random((size, size)) < 0.6)
    x = np.round(draw.random((users, size)), 3) * (draw.random((users, size)) < 0.25)
    x[7] = np.arange(1, size + 1)  # One user has everything.
    monkeypatch.setattr(M, "TASK_BYTES", 2 * 8 * size)
    monkeypatch.setattr(M, "ENTRIES", 30)
    monkeypatch.setattr(M, "TILE", 3)
    blocks = [(i // block, j // block, len(b[i : i + block]), b[i : i + block, j : j + block].tobytes()) for i in range(0, size, block) for j in range(0, size, block)]
    matrix = spark.createDataFrame([(i, j, n, bytearray(d)) for i, j, n, d in blocks], M.BLOCKS)
    rows = spark.createDataFrame([(int(u), int(i), float(x[u, i])) for u, i in zip(*np.nonzero(x))], "row_id long, i long, w double")
    got = {(r.row_id, r["rank"]): (r.j, r.score) for r in M.sparse_times_dense(rows, matrix, size, block, 5, seen).collect()}
    votes = (x != 0).astype(int) @ (b != 0).astype(int)
    scores = np.where((votes > 0) & ~(seen & (x != 0)), np.round(x @ b, 9), -np.inf)
    want = {}
    for u in range(users):
        best = sorted((-scores[u, j], j) for j in range(size) if scores[u, j] > -np.inf)[:5]
        want |= {(u, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_full_columns_of_30000_items_stay_bounded(spark, monkeypatch):
    size, block = 30_000, 512
    monkeypatch.setattr(M, "TASK_BYTES", 4 << 20)
    assert M.column_width(size, block) * size * 8 <= M.TASK_BYTES and M.column_width(10**9, block) == 1
    draw = np.random.default_rng(6)
    columns = draw.standard_normal((size, 40))
    blocks = [(i // block, 0, len(columns[i : i + block]), bytearray(columns[i : i + block].tobytes())) for i in range(0, size, block)]
    matrix = spark.createDataFrame(blocks, M.BLOCKS)
    items = [draw.choice(size, 20, replace=False) for _ in range(30)]
    rows = spark.createDataFrame([(u, int(i), 1.0) for u, mine in enumerate(items) for i in mine], "row_id long, i long, w double")
    got = M.sparse_times_dense(rows, matrix, size, block, 3).collect()
    for u, mine in enumerate(items):
        scores = np.round(columns[mine].sum(axis=0), 9)
        best = np.argsort(-scores, kind="stable")[:3]
        assert [r.j for r in sorted((r for r in got if r.row_id == u), key=lambda r: r["rank"])] == best.tolist()


def test_residual_finds_wrong_weights(spark):
    draw = np.random.default_rng(9)
    x = np.round(draw.random((60, 9)), 2) * (draw.random((60, 9)) < 0.4)
    inter = spark.createDataFrame([(int(u), f"i{i}", float(x[u, i])) for u, i in zip(*np.nonzero(x))], "user_id long, item_id string, weight double")
    gram = linear.item_gram(inter).cache()
    model = linear.closed_form(gram, 3.0, block=4)
    residual = {r.item_j: r.residual for r in linear.normal_equations(gram, model.weights(), 3.0).collect()}
    assert len(residual) == 9 and max(residual.values()) < 1e-9
    worse = model.weights().replace(0.0, 1.0).selectExpr("item_i", "item_j", "weight + 0.01 AS weight")
    assert min(r.residual for r in linear.normal_equations(gram, worse, 3.0).collect()) > 1e-4
    # Scores from blocks are those from rows.
    ours = {(r.user_id, r.item_id): r.score for r in model.scores(inter, 9).collect()}
    rows = {(r.user_id, r.item_id): r.score for r in linear.item_ridge_scores(inter, model.weights(), 9).collect()}
    assert ours.keys() == rows.keys() and all(abs(ours[k] - rows[k]) < 1e-8 for k in rows)
