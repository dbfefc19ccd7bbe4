"""Whitening against numpy's eigenvectors and plain whole-number arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import whitening
from basketry.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<double>, label int, n long, component int, id string, vector string"


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 5, 6, "i", "v") for i, v in vectors], ROWS).repartition(3)


def plain(vectors, components=8, scale=1024, shift=100_000):
    """{(place, component): (deviation, whitened, explained)} and n, by whole numbers and numpy's eigenvectors."""
    good = [v for v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for v in good)
    x = [[int(np.floor(scale * c)) + shift for c in [*v, *[0.0] * (width - len(v))]] for v in good]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    off = np.array([[n * a - s for a, s in zip(row, sums)] for row in x], object)
    deviation = [sum(int(a) ** 2 for a in row) for row in off]
    centred = off.astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    white = centred @ basis[:, order] / np.sqrt(values[order])
    return n, deviation, white, values[order] / values.sum()


def check(found, vectors, components=8):
    n, deviation, white, explained = plain(vectors, components)
    by = {(r["vec_id"], r["component"]): r for r in found}
    good = [i for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert len(found) == len(by) == len(good) * white.shape[1]
    for c in range(white.shape[1]):
        ours = np.array([by[i, c + 1]["whitened"] for i in good])
        sign = np.sign(ours @ white[:, c])
        assert np.abs(sign * ours - white[:, c]).max() < 1e-6
        assert all(by[i, c + 1]["deviation"] == d and by[i, c + 1]["n"] == n for i, d in zip(good, deviation))
        assert abs(by[good[0], c + 1]["explained"] - explained[c]) < 1e-9
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


def test_query_equals_plain_version(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    found = QUERIES["op12_embedding_whitening"](spark, sf).collect()
    place = {r["vec_id"]: n for n, r in enumerate(rows)}
    assert len(place) == len(rows)
    moved = [r.asDict() | {"vec_id": place[r["vec_id"]]} for r in found]
    check(moved, [r["embedding"] for r in rows])


def test_awkward_vectors(spark):
    draw = np.random.default_rng(3)
    vectors = [list(map(float, draw.standard_normal(5) * [3, 2, 1, 0.5, 0.1])) for _ in range(60)]
    vectors += [None, [1.0, None, 2.0], [float("nan")] * 5, [float("inf"), 0.0], [], [0.25, -0.5], vectors[0], vectors[0]]
    found = whitening.whitened(rows_of(spark, enumerate(vectors)), components=4)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), vectors, 4)
    # Fewer dimensions than components; ids that are null or repeat are rows like others.
    found = whitening.whitened(rows_of(spark, [(None, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [0.5, 3.0])]), components=8).collect()
    assert sorted((r["vec_id"] is None, r["component"]) for r in found) == [(False, 1), (False, 1), (False, 2), (False, 2), (True, 1), (True, 2)]


def test_large_entries_stay_exact(spark):
    vectors = [[1e9, -1e8], [-1e9, 3.0], [2e12, 5e8], [0.125, -7e8]]
    found = whitening.whitened(rows_of(spark, enumerate(vectors)), components=2).collect()
    capped = [[min(x, float(1 << 30)) for x in v] for v in vectors]
    n, deviation, _, _ = plain(capped, 2)
    for r in found:
        assert r["n"] == n and r["deviation"] == min(deviation[r["vec_id"]], (1 << 63) - 1)
    y = np.random.default_rng(1).integers(-(1 << 41), 1 << 41, (700, 3))
    assert (whitening._products(y) == y.astype(object).T @ y.astype(object)).all()


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, [None]], [[], []]])
def test_no_variance_gives_no_rows(spark, vectors):
    assert whitening.whitened(rows_of(spark, enumerate(vectors))).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_principal_components(size):
    draw = np.random.default_rng(size)
    q, _ = np.linalg.qr(draw.standard_normal((size, size)))
    spectra = [draw.random(size), np.ones(size), np.round(draw.random(size) * 3), 10.0 ** -np.arange(size).clip(0, 12), np.zeros(size)]
    for spectrum in spectra:
        a = (q * spectrum) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.principal_components(a, 8)
        scale = max(1e-300, np.abs(spectrum).max())
        assert np.abs(values - np.sort(spectrum)[::-1][:8]).max() < 1e-13 * scale * size + 1e-15
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale * size + 1e-15
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_polar_factor_is_orthogonal():
    draw = np.random.default_rng(5)
    a = draw.standard_normal((20, 20))
    a = a + a.T
    u = whitening.polar_factor(a)
    assert np.abs(u @ u.T - np.eye(20)).max() < 1e-13 and (np.linalg.eigvalsh(u @ a) > -1e-12).all()
    assert whitening.polar_factor(np.zeros((3, 3)) + np.diag([1.0, 1.0, 0.0])) is None


def test_rows_do_not_depend_on_their_order(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    one = whitening.whitened(rows.coalesce(1)).orderBy("vec_id", "component").collect()
    many = whitening.whitened(rows.repartition(7, F.rand(1))).orderBy("vec_id", "component").collect()
    assert [(*r[:4], r[5]) for r in one] == [(*r[:4], r[5]) for r in many]
    # The last bit of a product may depend on how many rows are multiplied at once.
    assert np.allclose([r[4] for r in one], [r[4] for r in many], rtol=1e-12, atol=1e-14)
