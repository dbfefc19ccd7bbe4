"""Queries over item sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import sequences as Q
from basketry.plans.registry import query
from basketry.plans.sqlbase import on_log
from basketry.sources import events, fixtures


def text(column: str):
    return F.array_join(F.transform(column, lambda i: i.cast("string")), "|").alias(column)


@query(
    "user_sequences",
    on_log("""SELECT user_id, CAST(pos//25 AS BIGINT) AS chunk, string_agg(CAST(item_id AS VARCHAR),'|' ORDER BY pos) AS items FROM
      (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id)-1 AS pos FROM log) GROUP BY 1,2"""),
)
def user_sequences(spark, sf):
    return Q.user_sequences(fixtures.activity_log(spark, sf), 25).select("user_id", "chunk", text("items"))


KNOWN = "ix AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS item_idx FROM (SELECT DISTINCT item_id FROM log WHERE event_type='view' AND brand IS NOT NULL))"


def known_items(log):
    """Items that were viewed and have a brand, numbered from 1."""
    viewed = log.filter("event_type = 'view' and brand is not null")
    return events.dense_index(viewed, "item_id", "_i").select("item_id", (F.col("_i") + 1).alias("item_idx"))


@query(
    "pad_sequences",
    on_log("""SELECT user_id, CAST(count(*) AS INTEGER) AS length, array_to_string(list_concat(list(item_idx ORDER BY r DESC), list_transform(range(50-count(*)), lambda z: 0)),'|') AS sequence FROM
      (SELECT user_id, item_idx, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS r FROM log JOIN ix USING (item_id)) WHERE r<=50 GROUP BY 1""", KNOWN),
)
def pad_sequences(spark, sf):
    log = fixtures.activity_log(spark, sf)
    return Q.pad_sequences(log, known_items(log)).select("user_id", "length", text("sequence"))


@query(
    "behavior_sequences",
    on_log("""SELECT user_id, CAST(count(*) AS INTEGER) AS length, array_to_string(list_concat(list(item_idx ORDER BY r DESC), list_transform(range(30-count(*)), lambda z: 0)),'|') AS sequence,
      array_to_string(list_concat(list(b ORDER BY r DESC), list_transform(range(30-count(*)), lambda z: 0)),'|') AS behaviors FROM
      (SELECT user_id, item_idx, CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2 ELSE 3 END AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS r FROM log JOIN ix USING (item_id)
       WHERE event_type IN ('view','cart','purchase')) WHERE r<=30 GROUP BY 1""", KNOWN),
)
def behavior_sequences(spark, sf):
    log = fixtures.activity_log(spark, sf)
    return Q.behavior_sequences(log, known_items(log), 30).select("user_id", "length", text("sequence"), text("behaviors"))


def draw_sql(key: str) -> str:
    return f"(('0x'||substr(md5('42:'||user_id||':'||{key}),1,10))::BIGINT/1099511627776.0::DOUBLE)"


AUGMENTED = [
    """padded AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n, list(item_idx ORDER BY r DESC) AS xs FROM
      (SELECT user_id, item_idx, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS r FROM log JOIN ix USING (item_id)) WHERE r<=50 GROUP BY 1)""",
    "sized AS (SELECT *, greatest(1, CAST(floor(n*0.6::DOUBLE) AS INTEGER)) AS keep, greatest(2, CAST(floor(n*0.4::DOUBLE) AS INTEGER)) AS span, (SELECT count(*) FROM ix) AS known FROM padded)",
    f"placed AS (SELECT *, CAST(floor({draw_sql(chr(39) + 'crop' + chr(39))}*(n-keep+1)) AS INTEGER) AS c, CAST(floor({draw_sql(chr(39) + 'span' + chr(39))}*(n-span+1)) AS INTEGER) AS s, CAST(floor({draw_sql(chr(39) + 'kind' + chr(39))}*3) AS INTEGER) AS which FROM sized)",
    f"""varied AS (SELECT user_id, CASE WHEN which=0 THEN CASE WHEN n<=1 THEN xs ELSE xs[c+1:c+keep] END
      WHEN which=1 THEN list_transform(xs, lambda x, i: CASE WHEN {draw_sql("(i-1)||':mask'")}<0.4::DOUBLE THEN 1+CAST(floor({draw_sql("(i-1)||':item'")}*greatest(1,known)) AS BIGINT) ELSE x END)
      ELSE CASE WHEN n<=2 THEN xs ELSE list_concat(xs[1:s], list_transform(list_sort(list_transform(xs[s+1:s+span], lambda x, i: struct_pack(o := {draw_sql("(i-1)||':order'")}, i := i, x := x))), lambda z: z.x), xs[s+span+1:]) END END AS v FROM placed)""",
]


@query(
    "augment_sequences",
    on_log("SELECT user_id, CAST(len(v) AS INTEGER) AS length, array_to_string(list_concat(v, list_transform(range(50-len(v)), lambda z: 0)),'|') AS sequence FROM varied", KNOWN, *AUGMENTED),
)
def augment_sequences(spark, sf):
    log = fixtures.activity_log(spark, sf)
    known = known_items(log)
    return Q.augment_sequences(Q.pad_sequences(log, known), "random", 0.4, known.count() + 1).select("user_id", "length", text("sequence"))
