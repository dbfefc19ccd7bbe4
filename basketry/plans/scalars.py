"""Queries over column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import scalars as S
from basketry.functions import text as X
from basketry.plans.registry import query
from basketry.plans.sqlbase import on_log
from basketry.runtime import scalar
from basketry.sources import fixtures


@query("normalize_time", on_log("SELECT event_id, date_trunc('second', event_time) AS event_time FROM log"))
def normalize_time(spark, sf):
    log = fixtures.activity_log(spark, sf)
    text = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return log.select("event_id", S.normalize_time(text).alias("event_time"))


@query(
    "event_weight",
    on_log("SELECT event_id, CASE event_type WHEN 'view' THEN 1.0 WHEN 'cart' THEN 3.0 ELSE 5.0 END::DOUBLE AS weight FROM log WHERE event_type IN ('view','cart','purchase')"),
)
def event_weight(spark, sf):
    return S.with_event_weight(fixtures.activity_log(spark, sf), S.BEHAVIOR_WEIGHTS).select("event_id", "weight")


@query(
    "last_days",
    on_log("SELECT event_id FROM log WHERE event_time >= (SELECT max(event_time) FROM log) - INTERVAL 14 DAY"),
)
def last_days(spark, sf):
    return S.last_days(fixtures.activity_log(spark, sf), 14).select("event_id")


@query("unix_seconds", on_log("SELECT event_id, CAST(floor(epoch_us(event_time)/1e6) AS BIGINT) AS seconds FROM log"))
def unix_seconds(spark, sf):
    return fixtures.activity_log(spark, sf).select("event_id", S.unix_seconds(F.col("event_time")).alias("seconds"))


@query(
    "behavior_id",
    on_log("SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2 ELSE 3 END AS behavior_id FROM log WHERE event_type IN ('view','cart','purchase')"),
)
def behavior_id(spark, sf):
    return S.with_behavior_id(fixtures.activity_log(spark, sf)).select("event_id", "behavior_id")


@query(
    "days_ago",
    on_log("""SELECT event_id, round((epoch_us(m)-epoch_us(event_time))/86400e6,6) AS days_ago,
      CAST(floor((epoch_us(m)-epoch_us(event_time))/86400e6) AS INTEGER) AS whole_days FROM log, (SELECT max(event_time) AS m FROM log)"""),
)
def days_ago(spark, sf):
    log = fixtures.activity_log(spark, sf)
    latest = scalar(log, F.max("event_time"))
    return S.with_days_ago(log).select(
        "event_id",
        F.round("days_ago", 6).alias("days_ago"),
        S.age_in_days(F.col("event_time"), latest, whole=True).alias("whole_days"),
    )


@query(
    "category_levels",
    on_log("""SELECT event_id, split_part(category_code,'.',1) AS l1, split_part(category_code,'.',1)||'.'||split_part(category_code,'.',2) AS category_l2,
      split_part(category_code,'.',2) AS cat_l2, coalesce(split_part(category_code,'.',2),'unknown') AS alias_l2, split_part(category_code,'.',3) AS alias_l3 FROM log"""),
)
def category_levels(spark, sf):
    levels = S.category_levels(F.col("category_code"))
    return fixtures.activity_log(spark, sf).select("event_id", *[c.alias(n) for n, c in levels.items()])


@query(
    "brand_slug",
    on_log("""SELECT event_id, coalesce(nullif(trim(regexp_replace(lower(brand),'[^a-z0-9]+','-','g'),'-'),''),'unknown') AS slug,
      CASE WHEN price IS NULL THEN 'mid' WHEN price<30 THEN 'low' WHEN price<=80 THEN 'mid' ELSE 'high' END AS bucket FROM log"""),
)
def brand_slug(spark, sf):
    return fixtures.activity_log(spark, sf).select(
        "event_id", S.brand_slug(F.col("brand")).alias("slug"), S.price_bucket(F.col("price")).alias("bucket")
    )


@query(
    "remap_brand",
    on_log("SELECT event_id, CASE lower(brand) WHEN 'brand#1' THEN 'house' WHEN 'brand#2' THEN 'house' ELSE brand END AS brand FROM log"),
)
def remap_brand(spark, sf):
    mapped = S.remap_brand(F.col("brand"), {"brand#1": "house", "brand#2": "house"})
    return fixtures.activity_log(spark, sf).select("event_id", mapped.alias("brand"))


@query(
    "rare_to_unk",
    on_log("""SELECT event_id, CASE WHEN category_code IS NULL THEN NULL WHEN n<300 THEN 'UNK' ELSE category_code END AS category_code_mapped
      FROM log LEFT JOIN (SELECT category_code AS c, count(*) AS n FROM log GROUP BY 1) ON c=category_code"""),
)
def rare_to_unk(spark, sf):
    return S.rare_to_unk(fixtures.activity_log(spark, sf), "category_code", 300).select(
        "event_id", "category_code_mapped"
    )


PRICE_EDGES = [0, 25, 50, 75, 100, 150, 200, 300, 500, 1000, float("inf")]
PRICE_LABELS = ["0-25", "25-50", "50-75", "75-100", "100-150", "150-200", "200-300", "300-500", "500-1k", "1k+"]
PRICE_CASE = (
    "CASE WHEN price<0 THEN NULL WHEN price<25 THEN '0-25' WHEN price<50 THEN '25-50' WHEN price<75 THEN '50-75' "
    "WHEN price<100 THEN '75-100' WHEN price<150 THEN '100-150' WHEN price<200 THEN '150-200' WHEN price<300 THEN '200-300' "
    "WHEN price<500 THEN '300-500' WHEN price<1000 THEN '500-1k' ELSE '1k+' END"
)


@query("bucketize", on_log(f"SELECT event_id, {PRICE_CASE} AS price_bin FROM log"))
def bucketize(spark, sf):
    binned = S.bucketize(F.col("price"), PRICE_EDGES, PRICE_LABELS, right=False)
    return fixtures.activity_log(spark, sf).select("event_id", binned.alias("price_bin"))


@query(
    "price_fit",
    on_log("""SELECT event_id, coalesce(price BETWEEN m-1.5*(q3-q1) AND m+1.5*(q3-q1), false) AS in_band, round(abs(price-m)/greatest(abs(m),1),6) AS distance
      FROM log LEFT JOIN (SELECT user_id AS u, median(price) AS m, quantile_cont(price,0.25) AS q1, quantile_cont(price,0.75) AS q3 FROM log WHERE event_type='view' GROUP BY 1) ON u=user_id"""),
)
def price_fit(spark, sf):
    from basketry.operators.distributed import exact_quantiles

    log = fixtures.activity_log(spark, sf)
    bands = exact_quantiles(
        log.filter("event_type = 'view'"), ["user_id"], "price", {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    )
    inside, distance = S.price_fit(F.col("price"), F.col("p50"), F.col("p75") - F.col("p25"))
    return log.join(bands, "user_id", "left").select(
        "event_id", inside.alias("in_band"), S.half_up(distance, 6).alias("distance")
    )


@query(
    "log1p_counts",
    on_log("""SELECT user_id, round(ln(1+count(*)),6) AS n_log1p, round(1-count(DISTINCT item_id)*1.0/count(*),6) AS repeat_ratio,
      round(count(*) FILTER (WHERE event_type='cart')*1.0/greatest(count(*) FILTER (WHERE event_type='view'),1),6) AS cart_view FROM log GROUP BY 1"""),
)
def log1p_counts(spark, sf):
    counts = fixtures.activity_log(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("item_id").alias("d"),
        F.count_if(F.col("event_type") == "cart").alias("c"),
        F.count_if(F.col("event_type") == "view").alias("v"),
    )
    return counts.select(
        "user_id",
        F.round(F.log1p("n"), 6).alias("n_log1p"),
        F.round(S.repeat_ratio(F.col("d"), F.col("n")), 6).alias("repeat_ratio"),
        F.round(S.ratio(F.col("c"), F.col("v")), 6).alias("cart_view"),
    )


@query(
    "calendar_fields",
    on_log("""SELECT event_id, strftime(event_time,'%Y-%m-%d') AS date, CAST(hour(event_time) AS INTEGER) AS hour,
      CAST(isodow(event_time)-1 AS INTEGER) AS dow, dayname(event_time) AS weekday FROM log"""),
)
def calendar_fields(spark, sf):
    return S.with_calendar(fixtures.activity_log(spark, sf)).select(
        "event_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "hour", "dow", "weekday"
    )


@query(
    "classify_intent",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text,'\\buser_\\d+\\b') THEN 'user_id'
       WHEN contains(text,'the') OR contains(text,'une') OR contains(text,'data') THEN 'shopping' ELSE 'general' END AS intent,
       nullif(regexp_extract(text,'\\buser_\\d+\\b'),'') AS user_alias FROM conversations""",
)
def classify_intent(spark, sf):
    text = F.col("text")
    return fixtures.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.classify_intent(text, ["the", "une", "data"]).alias("intent"), X.user_alias(text).alias("user_alias")
    )


@query(
    "looks_negated",
    "SELECT doc_id, regexp_matches(text,'(?i)없|아니|\\b(not|no|never)\\b') AS negated FROM documents",
)
def looks_negated(spark, sf):
    return fixtures.table(spark, sf, "documents").select("doc_id", X.looks_negated(F.col("text")).alias("negated"))


@query(
    "category_keyword",
    on_log("""SELECT event_id, CASE WHEN t3='small' THEN 'tiny things' WHEN t3='red' THEN 'red things' WHEN t2='ring' THEN 'rings' ELSE 'anything' END AS words,
       ['a','b','c','d','e','f','g'][CAST(1 + (((c1*4+c2)%7*4+c3)%7*4+c4)%7 AS INTEGER)] AS picked
       FROM (SELECT event_id, split_part(category_code,'.',2) AS t2, split_part(category_code,'.',3) AS t3,
         CAST('0x'||substr(md5(CAST(event_id AS VARCHAR)),1,8) AS BIGINT) AS c1, CAST('0x'||substr(md5(CAST(event_id AS VARCHAR)),9,8) AS BIGINT) AS c2,
         CAST('0x'||substr(md5(CAST(event_id AS VARCHAR)),17,8) AS BIGINT) AS c3, CAST('0x'||substr(md5(CAST(event_id AS VARCHAR)),25,8) AS BIGINT) AS c4 FROM log)"""),
)
def category_keyword(spark, sf):
    words = {"small": "tiny things", "red": "red things", "ring": "rings", "other": "anything"}
    code = F.col("category_code")
    options = F.array(*[F.lit(x) for x in "abcdefg"])
    return fixtures.activity_log(spark, sf).select(
        "event_id",
        X.category_keyword(code, S.category_path(code), words, "other").alias("words"),
        X.hash_pick(F.col("event_id").cast("string"), options).alias("picked"),
    )


@query(
    "apply_temperature",
    """SELECT doc_id, round(1/(1+exp(-ln(p/(1-p))/1.7)),6) AS calibrated FROM
       (SELECT doc_id, least(greatest((doc_id*37 % 101)/100.0,1e-7),1-1e-7)::DOUBLE AS p FROM labels)""",
)
def apply_temperature(spark, sf):
    confidence = (F.col("doc_id") * 37 % 101) / 100.0
    return fixtures.table(spark, sf, "labels").select(
        "doc_id", F.round(S.apply_temperature(confidence, 1.7), 6).alias("calibrated")
    )
