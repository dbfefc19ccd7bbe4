"""The skew-safe building blocks against plain pandas, with one key that holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import conversion, distributed as D
from basketry.operators.linear import item_gram, item_ridge


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 6000
    users = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 60, n))
    return pd.DataFrame(
        {
            "event_id": np.arange(n),
            "user_id": users,
            "item_id": rng.integers(0, 25, n),
            "event_type": rng.choice(["view", "cart", "purchase"], n, p=[0.7, 0.2, 0.1]),
            "event_time": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 86400, n), unit="s"),
            "price": np.round(rng.normal(0, 40, n), 1),
        }
    )


@pytest.fixture(scope="module")
def log(spark, skewed):
    return spark.createDataFrame(skewed).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def test_positions(log, skewed):
    got = D.keyed_position(
        log, ["user_id"], ["event_time", "event_id"], F.date_trunc("hour", F.col("event_time")), "p", "n"
    ).select("event_id", "p", "n").toPandas().set_index("event_id").sort_index()
    want = skewed.sort_values(["event_time", "event_id"])
    assert (want.groupby("user_id").cumcount().sort_index().to_numpy() == got.p.to_numpy()).all()
    assert (skewed.groupby("user_id").user_id.transform("size").to_numpy() == got.n.to_numpy()).all()


@pytest.mark.parametrize("keys", [[], ["user_id"]])
def test_quantiles(log, skewed, keys):
    ps = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = D.exact_quantiles(log, keys, "price", ps).toPandas()
    if not keys:
        assert np.allclose(got.iloc[0][list(ps)].to_numpy(dtype=float), skewed.price.quantile(list(ps.values())).to_numpy())
        return
    got = got.set_index("user_id").sort_index()
    for name, p in ps.items():
        assert np.allclose(got[name].to_numpy(), skewed.groupby("user_id").price.quantile(p).sort_index().to_numpy())


def test_gaps(log, skewed):
    got = D.gaps_to_previous(log, ["user_id"], "event_time", "event_time", F.to_date("event_time")).toPandas()
    want = skewed.sort_values(["user_id", "event_time"]).groupby("user_id").event_time.diff().dropna()
    assert np.allclose(np.sort(got.gap_us.to_numpy() / 1e6), np.sort(want.dt.total_seconds().to_numpy()))


def test_sorted_index_does_not_depend_on_partitions(log):
    a = D.sorted_index(log.select("price", "event_id"), [F.desc("price"), "event_id"], "i").toPandas()
    b = D.sorted_index(log.repartition(13).select("price", "event_id"), [F.desc("price"), "event_id"], "i").toPandas()
    a, b = a.sort_values("event_id"), b.sort_values("event_id")
    assert (a.i.to_numpy() == b.i.to_numpy()).all() and sorted(a.i) == list(range(len(a)))
    ordered = a.sort_values("i")
    assert (ordered.price.to_numpy()[:-1] >= ordered.price.to_numpy()[1:]).all()


def test_most_frequent_breaks_ties_low(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k int, v string")
    got = {r.k: r.v for r in D.most_frequent(df, ["k"], ["v"]).collect()}
    assert got == {1: "a"}


def test_pairs_are_counted_like_a_join(log, skewed):
    views, buys = (skewed[skewed.event_type == t] for t in ("view", "purchase"))
    joined = views.merge(buys, on=["user_id", "item_id"])
    want = int((joined.event_time_y > joined.event_time_x).sum())
    row = conversion.temporal_pairs(log, [("view", "purchase")]).first()
    assert (row.n_pairs, row.n_from) == (want, len(views))


@pytest.fixture(scope="module")
def interactions(spark, skewed):
    pairs = skewed.groupby(["user_id", "item_id"]).size().rename("weight").reset_index().astype({"weight": float})
    return pairs, spark.createDataFrame(pairs)


def dense(pairs):
    return pairs.pivot(index="user_id", columns="item_id", values="weight").fillna(0).to_numpy()


@pytest.mark.parametrize("block", [4, 256])
def test_gram_in_blocks(interactions, block):
    pairs, df = interactions
    x = dense(pairs)
    got = item_gram(df, block).toPandas().pivot(index="item_i", columns="item_j", values="value").fillna(0).to_numpy()
    assert np.allclose(got, x.T @ x)


@pytest.mark.parametrize("options", [{"block": 7}, {"block": 1024}, {"k_neighbors": 24}])
def test_ridge_equals_closed_form(interactions, options):
    pairs, df = interactions
    x = dense(pairs)
    p = np.linalg.inv(x.T @ x + 200.0 * np.eye(x.shape[1]))
    want = -p / np.diag(p)
    np.fill_diagonal(want, 0)
    got = item_ridge(item_gram(df), 200.0, **options).toPandas()
    got = got.pivot(index="item_i", columns="item_j", values="weight").fillna(0).to_numpy()
    assert np.allclose(got, want, atol=1e-8)
