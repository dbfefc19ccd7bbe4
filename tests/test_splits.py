import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import lookups, splits
from basketry.sources import events, tables


@pytest.fixture
def log(spark):
    """Events by hour; the last 36 hours begin after hour 64."""
    start = dt.datetime(2031, 5, 3, 7)
    rows = [
        (5, "ann", "ink", "purchase"), (12, "dan", "oak", "view"), (40, "ann", "oak", "view"), (55, "ben", "fog", "cart"),
        (64, "ben", "fog", "purchase"), (65, "ann", "fog", "purchase"), (70, "cat", "ink", "purchase"), (88, "ann", "fog", "view"),
        (99, "dan", "sea", "purchase"), (100, "ben", "ink", "view"),
    ]
    data = [(n, user, item, kind, start + dt.timedelta(hours=h)) for n, (h, user, item, kind) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, user_id string, item_id string, event_type string, event_time timestamp_ntz")


def test_time_split(log):
    train, truth = splits.time_based_split(log, 1)
    assert [r.event_id for r in train.orderBy("event_id").collect()] == list(range(7))
    assert [(r.user_id, r.item_id) for r in truth.collect()] == [("dan", "sea")]
    train, truth = splits.time_based_split(log, 3)
    # dan's view at hour 12 is in the training part; cat has nothing before the cutoff.
    assert train.count() == 2 and truth.count() == 4
    assert sorted(r.user_id for r in splits.eval_users(truth, train).collect()) == ["ann", "dan"]
    with pytest.raises(ValueError):
        splits.time_based_split(log, 0)
    with pytest.raises(ValueError):
        splits.time_based_split(log.drop("event_type"))


def test_leave_one_out(log):
    train, truth = splits.leave_one_out_split(log)
    assert {(r.user_id, r.event_id) for r in truth.collect()} == {("ann", 5), ("ben", 4), ("cat", 6), ("dan", 8)}
    assert train.count() == 6
    train, truth = splits.leave_one_out_split(log, ["refund"])
    assert truth.count() == 0 and train.count() == 10


def test_empty_slices_are_kept(log):
    sliced = splits.val_slices(log, {"all": (None, None), "never": ("2040-01-01", None)})
    assert {r.slice for r in sliced.select("slice").distinct().collect()} == {"all"}


def test_folds_are_balanced_and_repeatable(spark):
    users = spark.range(103).select(F.col("id").alias("user_id"))
    sizes = [r["count"] for r in splits.user_folds(users, 5).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 103
    a = {r.user_id: r.fold for r in splits.user_folds(users, 5).collect()}
    b = {r.user_id: r.fold for r in splits.user_folds(users.repartition(7), 5).collect()}
    assert a == b


def test_string_times(spark):
    from basketry.functions.scalars import normalize_time

    df = spark.createDataFrame([("2020-02-29 23:59:58 UTC",)], "t string").select(normalize_time(F.col("t")).alias("t"))
    assert df.first().t == dt.datetime(2020, 2, 29, 23, 59, 58)
    with pytest.raises(Exception):
        spark.createDataFrame([("yesterday",)], "t string").select(normalize_time(F.col("t"))).collect()


def test_mappings(spark, log, tmp_path):
    path = str(tmp_path / "maps")
    users, items = tables.get_or_build_mappings(log, path)
    assert sorted((r.user_id, r.user_idx) for r in users.collect()) == [("ann", 0), ("ben", 1), ("cat", 2), ("dan", 3)]
    # A second call reads what is there, even for another log; force builds again.
    other = log.filter("user_id = 'cat'")
    assert tables.get_or_build_mappings(other, path)[0].count() == 4
    assert tables.get_or_build_mappings(other, path, force=True)[0].count() == 1
    with pytest.raises(Exception, match="without index"):
        lookups.add_idx_columns(log, *tables.load_mappings(spark, path)).collect()
    assert {r.kind: r.n for r in lookups.unknown_ids(log, *tables.load_mappings(spark, path)).collect()} == {"user": 3, "item": 3}


def test_topk_csv(spark, tmp_path):
    path = tmp_path / "lists.csv"
    path.write_text("user_id,item_id\n" + "".join(f"u{i % 3},i{i}\n" for i in range(30)))
    got = events.read_topk_csv(spark, str(path), 2).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.item_id, r.rank) for r in got][:2] == [("u0", "i0", 1), ("u0", "i3", 2)] and len(got) == 6
    bad = tmp_path / "bad.csv"
    bad.write_text("user,item\na,b\n")
    with pytest.raises(ValueError):
        events.read_topk_csv(spark, str(bad))


def test_profiles_are_upserted(spark, tmp_path):
    path = str(tmp_path / "profiles")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, note string")
    tables.save_profiles(first, path)
    tables.save_profiles(spark.createDataFrame([(2, "c"), (3, "d")], first.schema), path)
    assert {r.user_id: r.note for r in tables.load_profiles(spark, path).collect()} == {1: "a", 2: "c", 3: "d"}
    assert tables.load_profile(spark, path, 2).first().note == "c"
    with pytest.raises(FileNotFoundError):
        tables.load_profiles(spark, str(tmp_path / "none"))


def test_profiles_rewrite_touched_buckets_and_admit_one_writer(spark, tmp_path, monkeypatch):
    path = tmp_path / "profiles"
    rows = lambda ids, note: spark.createDataFrame([(i, note) for i in ids], "user_id long, note string")
    tables.save_profiles(rows(range(200), "a"), str(path), buckets=8)
    folders = lambda: {p.name for p in path.iterdir() if p.name.startswith("data-")}
    (first,) = folders()
    state = tables._manifest(spark, str(path))
    tables.save_profiles(rows([7], "b"), str(path))
    (second,) = folders() - {first}
    assert len([p for p in (path / second).iterdir() if p.name.startswith(tables.BUCKET)]) == 1
    # A writer that began from the first state fails and leaves everything as it is.
    before, found = folders(), {r.user_id: r.note for r in tables.load_profiles(spark, str(path)).collect()}
    with monkeypatch.context() as patched:
        patched.setattr(tables, "_manifest", lambda *_: state)
        with pytest.raises(FileExistsError):
            tables.save_profiles(rows([7, 8], "c"), str(path))
    assert folders() == before and {r.user_id: r.note for r in tables.load_profiles(spark, str(path)).collect()} == found
    assert found == {i: "b" if i == 7 else "a" for i in range(200)}
    # What neither of the last two states names is removed.
    for note in "def":
        tables.save_profiles(rows(range(200), note), str(path))
    assert len(folders()) == 2 and first not in folders() and len(list(path.glob("manifest-*"))) == 2
    assert tables.load_profile(spark, str(path), 7).first().note == "f" and tables.load_profiles(spark, str(path)).count() == 200
