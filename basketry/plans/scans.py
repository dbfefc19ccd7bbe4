"""Queries over readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.scalars import unix_seconds
from basketry.operators import splits, submission
from basketry.plans.registry import query
from basketry.plans.sqlbase import on_log, on_preds
from basketry.runtime import scratch_path
from basketry.sources import events, fixtures, tables


@query(
    "read_events",
    "SELECT event_type, count(*) AS n, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1",
)
def read_events(spark, sf):
    log = events.read_events(spark, f"{sf}/events.parquet")
    return log.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time")
    )


@query(
    "read_topk_csv",
    on_preds("SELECT user_id, item_id, rank FROM preds WHERE model='freq' AND rank<=10"),
)
def read_topk_csv(spark, sf):
    train, _ = splits.time_based_split(fixtures.activity_log(spark, sf))
    path = scratch_path(spark, "submission")
    tables.write_submission(fixtures.model_predictions(train).filter("model = 'freq'"), path)
    back = events.read_topk_csv(spark, path, 10)
    return back.select(F.col("user_id").cast("long"), F.col("item_id").cast("long"), "rank")


@query("target_users", "SELECT DISTINCT user_id FROM events")
def target_users(spark, sf):
    return events.target_users(fixtures.activity_log(spark, sf))


@query(
    "read_events_for",
    on_log("SELECT event_id, user_id, item_id, price FROM log WHERE user_id IN (SELECT user_id FROM truth)",
           "truth AS (SELECT DISTINCT user_id FROM log WHERE event_type='purchase' AND event_time > (SELECT max(event_time) FROM log) - INTERVAL 1 DAY)"),
)
def read_events_for(spark, sf):
    log = fixtures.activity_log(spark, sf)
    _, truth = splits.time_based_split(log, 1)
    path = scratch_path(spark, "log")
    log.write.parquet(path)
    return events.read_events_for(
        spark, path, users=truth.select("user_id").distinct(), columns=["event_id", "user_id", "item_id", "price"]
    )


@query("max_event_time", "SELECT max(ts) AS max_event_time FROM events")
def max_event_time(spark, sf):
    return events.max_event_time(fixtures.activity_log(spark, sf))


@query("write_predictions", on_preds("SELECT user_id, item_id, score, rank FROM preds WHERE model='spend'"))
def write_predictions(spark, sf):
    train, _ = splits.time_based_split(fixtures.activity_log(spark, sf))
    path = scratch_path(spark, "predictions")
    tables.write_predictions(fixtures.model_predictions(train).filter("model = 'spend'"), path)
    return spark.read.parquet(path)


@query(
    "write_submission",
    on_preds("""SELECT f.user_id, f.item_id FROM filled f""",
             """pop AS (SELECT item_id, count(*) AS n FROM train WHERE event_type='purchase' GROUP BY 1 ORDER BY n DESC, item_id LIMIT 50)""",
             """want AS (SELECT DISTINCT user_id FROM log)""",
             """cand AS (SELECT user_id, item_id, 0 AS src, rank AS ord FROM preds WHERE model='freq' AND rank<=10
                UNION ALL SELECT user_id, item_id, 1, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS INTEGER) FROM want, pop)""",
             """uniq AS (SELECT user_id, item_id, min(src*1000+ord) AS k FROM cand GROUP BY 1,2)""",
             """filled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS r FROM uniq) WHERE r<=10)"""),
)
def write_submission(spark, sf):
    log = fixtures.activity_log(spark, sf)
    train, _ = splits.time_based_split(log)
    filled = submission.fill_with_popularity(
        fixtures.model_predictions(train).filter("model = 'freq'"),
        events.target_users(log),
        submission.popularity(train, 50),
    )
    path = scratch_path(spark, "submission")
    tables.write_submission(filled, path)
    return spark.read.schema("user_id long, item_id long").option("header", True).csv(path)


@query(
    "write_interactions_tsv",
    on_log("""SELECT user_id, item_id, CAST(floor(epoch_us(event_time)/1e6) AS DOUBLE) AS "timestamp", CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2 ELSE 3 END AS behavior_id
              FROM log WHERE event_type IN ('view','cart','purchase')"""),
)
def write_interactions_tsv(spark, sf):
    from basketry.functions.scalars import with_behavior_id

    log = with_behavior_id(fixtures.activity_log(spark, sf)).withColumn("timestamp", unix_seconds(F.col("event_time")))
    path = scratch_path(spark, "tsv")
    kinds = {"user_id": "token", "item_id": "token", "timestamp": "float", "behavior_id": "token"}
    tables.write_interactions_tsv(log, path, kinds)
    back = tables.read_interactions_tsv(spark, path)
    return back.select(
        F.col("user_id").cast("long"), F.col("item_id").cast("long"), "timestamp", F.col("behavior_id").cast("int")
    )


@query(
    "save_mappings",
    on_log("""SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS id, row_number() OVER (ORDER BY user_id)-1 AS idx FROM (SELECT DISTINCT user_id FROM log)
      UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), row_number() OVER (ORDER BY item_id)-1 FROM (SELECT DISTINCT item_id FROM log)"""),
)
def save_mappings(spark, sf):
    log = fixtures.activity_log(spark, sf)
    path = scratch_path(spark, "mappings")
    tables.get_or_build_mappings(log, path)
    users, items = tables.get_or_build_mappings(log, path)
    return users.select(
        F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id"), F.col("user_idx").alias("idx")
    ).unionByName(
        items.select(
            F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("id"), F.col("item_idx").alias("idx")
        )
    )


EVIDENCE_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("rank", T.IntegerType())]))),
    ]
)


@query("write_evidence", on_preds("SELECT user_id, item_id, rank FROM preds WHERE model='recency' AND rank<=10"))
def write_evidence(spark, sf):
    train, _ = splits.time_based_split(fixtures.activity_log(spark, sf))
    top = fixtures.model_predictions(train).filter("model = 'recency' and rank <= 10")
    docs = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "rank"))).alias("items"))
    path = scratch_path(spark, "evidence")
    tables.write_evidence(docs, path)
    back = tables.read_evidence(spark, path, EVIDENCE_SCHEMA)
    return back.select("user_id", F.explode("items").alias("i")).select("user_id", "i.item_id", "i.rank")
