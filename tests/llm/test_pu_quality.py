"""Positive-unlabelled quality: held-out accuracy, the prior, the risk and awkward tables."""

import numpy as np
import pytest

from basketry.llm import pu_quality
from basketry.llm.common import Hasher
from basketry.llm.queries import GOOD_FROM, QUERIES
from tests.llm.conftest import LONG

FIXTURE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = QUERIES["op11_pu_quality"](spark, FIXTURE)
    labels = spark.read.parquet(f"{FIXTURE}/labels.parquet")
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert rows.count() == spark.read.parquet(f"{FIXTURE}/documents.parquet").count()
    judged = rows.filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.35
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean() > 0.98
    assert judged.score.between(0, 1).all() and (judged.predicted == (judged.score >= GOOD_FROM)).all()


def test_awkward_tables(spark, awkward, empty):
    positives = spark.createDataFrame([(3,), (3,), (5,), (None,), (99,)], "doc_id long")
    model = pu_quality.fit(awkward, positives)
    scored = pu_quality.score(awkward, model).collect()
    assert len(scored) == awkward.count() and all(0 <= r["score"] <= 1 for r in scored)
    texts, each = {}, [r["text"] for r in awkward.collect()]
    numbered = spark.createDataFrame(list(enumerate(each)), "doc_id long, text string")
    for r in pu_quality.score(numbered, model).collect():
        texts.setdefault(each[r["doc_id"]] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in texts.values())
    none = pu_quality.fit(awkward, positives.filter("doc_id > 1000"))
    assert all(r["score"] < 1e-17 for r in pu_quality.score(awkward, none).collect())
    assert pu_quality.score(empty, model).collect() == []
    assert pu_quality.score(empty, pu_quality.fit(empty, positives)).collect() == []


def test_one_id_on_many_rows_stays_bounded(spark):
    rows = spark.range(4000).selectExpr("1L AS doc_id", "concat('good words number ', id) AS text")
    model = pu_quality.fit(rows, spark.createDataFrame([(1,)], "doc_id long"), sample=50)
    assert 0 < model.prior <= 1 and pu_quality.score(rows, model).count() == 4000


def test_prior_of_a_mixture():
    draw = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.9):
        good = pu_quality._bars(draw.beta(5, 2, 4000))
        every = pu_quality._bars(np.concatenate([draw.beta(5, 2, int(prior * 20000)), draw.beta(1, 8, int((1 - prior) * 20000))]))
        assert abs(pu_quality.prior_from_counts(good, every) - prior) < 0.03
    assert pu_quality.prior_from_counts(np.zeros(5, int), np.ones(5, int)) == 0.5


def test_risk_and_its_slope():
    draw = np.random.default_rng(4)
    size, width = 40, 6

    def sparse(n):
        rows = np.repeat(np.arange(n), 2)
        return pu_quality.Sparse(rows, draw.integers(0, width, 2 * n), np.ones(2 * n), n)

    p, u = sparse(size), sparse(size)
    good, bad = pu_quality.risk(np.zeros(size), np.zeros(size), 0.4)
    assert good == pytest.approx(0.4 * np.log(2)) and bad == pytest.approx(0.6 * np.log(2))
    weights = pu_quality.fit_linear(p, u, width, 0.4)
    first, second = pu_quality.risk(p.times(weights[:-1]) + weights[-1], u.times(weights[:-1]) + weights[-1], 0.4)
    # Better than no model, and the second part is held near zero or above it.
    assert first + max(0, second) < np.log(2) and second > -0.05


def test_measures_of_style():
    text = "Aa bb bb, 12\nx | y\nx | y\n".encode()
    other = "été !!!".encode()
    data = np.frombuffer(text + other, np.uint8)
    style, owner, bucket = pu_quality.style_and_words(data, np.array([0, len(text), len(text) + len(other)]), Hasher())
    kinds = len(pu_quality.KINDS)
    assert style.shape == (2, pu_quality.STYLE) and style[:, :kinds].sum(axis=1) == pytest.approx([1, 1])
    words = text.decode().split()
    assert np.expm1(style[0, kinds]) == pytest.approx(len(text)) and np.expm1(style[0, kinds + 1]) == pytest.approx(len(words))
    assert style[0, kinds + 3] == pytest.approx(len(set(w.lower() for w in words)) / len(words))
    assert style[0, kinds + 6] == pytest.approx(2 / 3)  # One of three lines is there twice.
    assert set(owner) == {0, 1} and len(set(zip(owner.tolist(), bucket.tolist()))) == len(owner)
    assert len(LONG) > 300_000
    none = pu_quality.style_and_words(np.zeros(0, np.uint8), np.array([0, 0]), Hasher())
    assert none[0].shape == (1, pu_quality.STYLE) and len(none[1]) == 0
