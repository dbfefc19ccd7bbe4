"""Queries over item, user and pair features and the candidate table."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import context, features, lookups, submission, windows
from basketry.plans.common import MODELS, one_model, parts, preds, rounded, shop
from basketry.plans.registry import query
from basketry.plans.sqlbase import L2PATH, cnt, mode_of, on_log, on_orders, on_preds, on_shop, on_split
from basketry.sources import events, fixtures, tables
from basketry.runtime import scratch_path

AGE = "(epoch_us((SELECT max(event_time) FROM {t}))-epoch_us({e}))/86400e6"


@query(
    "popularity",
    on_split("""SELECT item_id, purchases, CAST(row_number() OVER (ORDER BY purchases DESC, item_id) AS INTEGER) AS rank
      FROM (SELECT item_id, count(*) AS purchases FROM train WHERE event_type='purchase' GROUP BY 1 ORDER BY purchases DESC, item_id LIMIT 50)"""),
)
def popularity(spark, sf):
    return submission.popularity(parts(spark, sf).train, 50)


ITEM_POP = f"""SELECT item_id, count(*) AS item_total_events, {cnt('view')} AS item_view, {cnt('cart')} AS item_cart, {cnt('purchase')} AS item_purchase,
 count(DISTINCT user_id) AS item_unique_users, round({AGE.format(t='train', e='min(event_time)')},6) AS item_days_since_first,
 round({AGE.format(t='train', e='max(event_time)')},6) AS item_days_since_last, round(avg(price),6) AS item_avg_price,
 round(ln(1+count(*)),6) AS item_total_events_log1p, round(ln(1+{cnt('view')}),6) AS item_view_log1p, round(ln(1+{cnt('cart')}),6) AS item_cart_log1p,
 round(ln(1+{cnt('purchase')}),6) AS item_purchase_log1p, round(ln(1+count(DISTINCT user_id)),6) AS item_unique_users_log1p FROM train GROUP BY 1"""
USER_ACT = f"""SELECT user_id, count(*) AS user_total_events, count(DISTINCT item_id) AS user_distinct_items, {cnt('view')} AS user_view, {cnt('cart')} AS user_cart, {cnt('purchase')} AS user_purchase,
 round({AGE.format(t='train', e='min(event_time)')},6) AS user_days_since_first, round({AGE.format(t='train', e='max(event_time)')},6) AS user_days_recency,
 round(1-count(DISTINCT item_id)*1.0/count(*),6) AS user_repeat_ratio, round({cnt('cart')}*1.0/greatest({cnt('view')},1),6) AS user_cart_view_ratio,
 round({cnt('purchase')}*1.0/greatest({cnt('view')},1),6) AS user_purchase_view_ratio,
 round(ln(1+count(*)),6) AS user_total_events_log1p, round(ln(1+count(DISTINCT item_id)),6) AS user_distinct_items_log1p, round(ln(1+{cnt('view')}),6) AS user_view_log1p,
 round(ln(1+{cnt('cart')}),6) AS user_cart_log1p, round(ln(1+{cnt('purchase')}),6) AS user_purchase_log1p FROM train GROUP BY 1"""
PAIR_HIST = f"""SELECT user_id, item_id, count(*) AS ui_total_events, round({AGE.format(t='train', e='max(event_time)')},6) AS ui_days_since_last,
 {cnt('view')} AS ui_view, {cnt('cart')} AS ui_cart, {cnt('purchase')} AS ui_purchase FROM train GROUP BY 1,2"""


@query("item_popularity", on_split(ITEM_POP))
def item_popularity(spark, sf):
    return rounded(features.item_popularity(parts(spark, sf).train))


@query("user_activity", on_split(USER_ACT))
def user_activity(spark, sf):
    return rounded(features.user_activity(parts(spark, sf).train))


@query("user_item_history", on_split(PAIR_HIST))
def user_item_history(spark, sf):
    return rounded(features.user_item_history(parts(spark, sf).train))


@query(
    "affinity_top1",
    on_split(f"""SELECT 'user' AS kind, user_id AS id, brand, category_code AS category FROM (SELECT DISTINCT user_id FROM train WHERE brand IS NOT NULL OR category_code IS NOT NULL)
       LEFT JOIN {mode_of('train','user_id','brand')} USING (user_id) LEFT JOIN {mode_of('train','user_id','category_code')} USING (user_id)
       UNION ALL SELECT 'item', item_id, brand, category_code FROM (SELECT DISTINCT item_id FROM train WHERE brand IS NOT NULL OR category_code IS NOT NULL)
       LEFT JOIN {mode_of('train','item_id','brand')} USING (item_id) LEFT JOIN {mode_of('train','item_id','category_code')} USING (item_id)"""),
)
def affinity_top1(spark, sf):
    users, items = features.affinity_top1(parts(spark, sf).train)
    return users.select(
        F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("user_top_brand").alias("brand"), F.col("user_top_category").alias("category")
    ).unionByName(
        items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("item_brand").alias("brand"), F.col("item_category").alias("category"))
    )


CATALOG = f"""SELECT item_id, count(*) AS total_events, count(*) FILTER (WHERE event_time >= (SELECT max(event_time) FROM log) - INTERVAL 14 DAY) AS recent14_events,
  max(event_time) AS last_seen, min(event_time) AS first_seen, any_value(c.category_code) AS category_code, any_value(b.brand) AS brand, round(median(price),6) AS price,
  any_value(split_part(c.category_code,'.',1)||'.'||split_part(c.category_code,'.',2)) AS category_l2
  FROM log LEFT JOIN {mode_of('log','item_id','category_code')} c USING (item_id) LEFT JOIN {mode_of('log','item_id','brand')} b USING (item_id) GROUP BY 1"""


@query("item_catalog", on_log(CATALOG))
def item_catalog(spark, sf):
    return rounded(features.item_catalog(fixtures.activity_log(spark, sf)))


@query("item_catalog_orders", on_orders(CATALOG))
def item_catalog_orders(spark, sf):
    return rounded(features.item_catalog(fixtures.order_log(spark, sf)))


RECENT = "event_time >= (SELECT max(event_time) FROM log) - INTERVAL 14 DAY"
BEFORE = f"NOT ({RECENT}) AND event_time >= (SELECT max(event_time) FROM log) - INTERVAL 28 DAY"
SIGNALS = f"""SELECT item_id, avg(price) AS price, ln(1+count(*)) AS item_pop_log1p, ln(1+count(*) FILTER (WHERE {RECENT})) AS item_recent14_pop_log1p,
 {cnt('view')} AS item_view_count, {cnt('cart')} AS item_cart_count, {cnt('purchase')} AS item_purchase_count,
 count(*) FILTER (WHERE event_type='view' AND {RECENT}) AS item_recent14_view_count, count(*) FILTER (WHERE event_type='view' AND {BEFORE}) AS item_prev14_view_count,
 any_value(c.category_code) AS category_code, any_value(split_part(c.category_code,'.',1)||'.'||split_part(c.category_code,'.',2)) AS category_l2x, any_value(l.category_l2) AS category_l2, any_value(b.brand) AS brand,
 ({cnt('cart')} + 50*(SELECT {cnt('cart')}*1.0/greatest({cnt('view')},1) FROM log))/({cnt('view')}+50) AS item_v2c_smoothed,
 ({cnt('purchase')} + 50*(SELECT {cnt('purchase')}*1.0/greatest({cnt('view')},1) FROM log))/({cnt('view')}+50) AS item_v2p_smoothed,
 (count(*) FILTER (WHERE event_type='view' AND {RECENT})+1.0)/(count(*) FILTER (WHERE event_type='view' AND {BEFORE})+1.0) AS item_recent_trend_ratio
 FROM log LEFT JOIN {mode_of('log','item_id','category_code')} c USING (item_id) LEFT JOIN {mode_of('log','item_id','category_l2',L2PATH)} l USING (item_id)
 LEFT JOIN {mode_of('log','item_id','brand')} b USING (item_id) GROUP BY 1"""


@query(
    "item_signals_base",
    on_log("""SELECT item_id, round(price,6) AS price, round(item_pop_log1p,6) AS item_pop_log1p, round(item_recent14_pop_log1p,6) AS item_recent14_pop_log1p, item_view_count, item_cart_count,
      item_purchase_count, item_recent14_view_count, item_prev14_view_count, category_code, category_l2, brand, round(item_v2c_smoothed,6) AS item_v2c_smoothed,
      round(item_v2p_smoothed,6) AS item_v2p_smoothed, round(item_recent_trend_ratio,6) AS item_recent_trend_ratio FROM sig""", f"sig AS ({SIGNALS})"),
)
def item_signals_base(spark, sf):
    return rounded(features.item_signals_base(fixtures.activity_log(spark, sf)))


@query(
    "smoothed_conversion",
    on_orders(f"""SELECT item_id, {cnt('view')} AS n_view, {cnt('purchase')} AS n_purchase,
      round(({cnt('purchase')} + 50*(SELECT {cnt('purchase')}*1.0/greatest({cnt('view')},1) FROM log))/({cnt('view')}+50),6) AS v2p_smoothed FROM log GROUP BY 1"""),
)
def smoothed_conversion(spark, sf):
    return rounded(features.item_conversion(fixtures.order_log(spark, sf)))


@query(
    "interaction_matrix",
    on_split("""SELECT user_id, item_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 3 ELSE 5 END)::DOUBLE AS weight
      FROM train WHERE event_type IN ('view','cart','purchase') GROUP BY 1,2"""),
)
def interaction_matrix(spark, sf):
    from basketry.functions.scalars import BEHAVIOR_WEIGHTS

    return features.interaction_matrix(parts(spark, sf).train, BEHAVIOR_WEIGHTS)


@query(
    "vocabularies",
    on_log("""SELECT 'category' AS kind, category_l2 AS value, CAST(sum(total_events) AS BIGINT) AS events FROM cat WHERE category_l2 IS NOT NULL GROUP BY 2
      UNION ALL SELECT * FROM (SELECT 'brand', brand, CAST(sum(total_events) AS BIGINT) AS e FROM cat WHERE brand IS NOT NULL GROUP BY 2 ORDER BY e DESC, brand LIMIT 20)""", f"cat AS ({CATALOG})"),
)
def vocabularies(spark, sf):
    catalog = features.item_catalog(fixtures.activity_log(spark, sf))
    categories, brands = features.vocabularies(catalog)
    return categories.select(F.lit("category").alias("kind"), F.col("category_l2").alias("value"), "events").unionByName(
        brands.select(F.lit("brand").alias("kind"), F.col("brand").alias("value"), "events")
    )


@query(
    "dense_index",
    on_orders("SELECT item_id, row_number() OVER (ORDER BY item_id)-1 AS item_id_idx FROM (SELECT DISTINCT item_id FROM log)"),
)
def dense_index(spark, sf):
    return events.dense_index(fixtures.order_log(spark, sf), "item_id")


@query(
    "add_idx_columns",
    on_log("""SELECT event_id, u.i AS user_idx, t.i AS item_idx FROM log JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id)-1 AS i FROM (SELECT DISTINCT user_id FROM log)) u USING (user_id)
      JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id)-1 AS i FROM (SELECT DISTINCT item_id FROM log)) t USING (item_id)"""),
)
def add_idx_columns(spark, sf):
    log = fixtures.activity_log(spark, sf)
    users, items = events.dense_index(log, "user_id", "user_idx"), events.dense_index(log, "item_id", "item_idx")
    return lookups.add_idx_columns(log, users, items).select("event_id", "user_idx", "item_idx")


@query(
    "attach_item_meta",
    on_preds(f"""SELECT user_id, item_id, rank, category_code, brand, price FROM preds LEFT JOIN (SELECT item_id, category_code, brand, price FROM ({CATALOG})) USING (item_id) WHERE model='freq'"""),
)
def attach_item_meta(spark, sf):
    p = parts(spark, sf)
    catalog = rounded(features.item_catalog(p.log))
    return lookups.attach_item_meta(one_model(p.train, "freq"), catalog).select(
        "user_id", "item_id", "rank", "category_code", "brand", "price"
    )


ITEM_ALIAS = """meta AS (SELECT item_id, avg(price) AS price, any_value(c.category_code) AS category_code, any_value(b.brand) AS brand FROM log
   LEFT JOIN {c} c USING (item_id) LEFT JOIN {b} b USING (item_id) GROUP BY 1),
 keyed AS (SELECT item_id, concat_ws('.', CASE WHEN category_code IS NULL THEN 'unknown' ELSE split_part(category_code,'.',2) END, split_part(category_code,'.',3),
   coalesce(nullif(trim(regexp_replace(lower(brand),'[^a-z0-9]+','-','g'),'-'),''),'unknown'), CASE WHEN price<30 THEN 'low' WHEN price<=80 THEN 'mid' ELSE 'high' END) AS k FROM meta),
 ialias AS (SELECT item_id, k||'_'||lpad(CAST(row_number() OVER (PARTITION BY k ORDER BY item_id) AS VARCHAR),4,'0') AS item_alias FROM keyed),
 ualias AS (SELECT user_id, 'user_'||lpad(CAST(row_number() OVER (ORDER BY user_id) AS VARCHAR),5,'0') AS user_alias FROM (SELECT DISTINCT user_id FROM log))""".format(
    c=mode_of("log", "item_id", "category_code"), b=mode_of("log", "item_id", "brand")
)


@query("item_aliases", on_log("SELECT item_id, item_alias FROM ialias", ITEM_ALIAS))
def item_aliases(spark, sf):
    return windows.item_aliases(windows.alias_items(fixtures.activity_log(spark, sf)))


@query("item_aliases_orders", on_orders("SELECT item_id, item_alias FROM ialias", ITEM_ALIAS))
def item_aliases_orders(spark, sf):
    return windows.item_aliases(windows.alias_items(fixtures.order_log(spark, sf)))


@query(
    "attach_aliases",
    on_preds("SELECT user_id, item_id, rank, item_alias, user_alias FROM preds JOIN ialias USING (item_id) JOIN ualias USING (user_id) WHERE model='freq'", ITEM_ALIAS),
)
def attach_aliases(spark, sf):
    p = parts(spark, sf)
    items = windows.item_aliases(windows.alias_items(p.log))
    return lookups.attach_aliases(one_model(p.train, "freq"), windows.user_aliases(p.log), items).select(
        "user_id", "item_id", "rank", "item_alias", "user_alias"
    )


MODEL_WIDE = """SELECT user_id, item_id, """ + ", ".join(
    f"coalesce(max(CASE WHEN model='{m}' THEN ns END),0.0) AS {m}_norm_score, CAST(coalesce(max(CASE WHEN model='{m}' THEN rank END),60) AS INTEGER) AS {m}_rank, "
    f"CAST(coalesce(max(CASE WHEN model='{m}' AND rank<=10 THEN 1 END),0) AS INTEGER) AS {m}_in_top10"
    for m in MODELS
) + """ FROM (SELECT *, CASE WHEN hi>lo THEN (score-lo)/(hi-lo) ELSE 1.0 END AS ns FROM (SELECT *, max(score) OVER (PARTITION BY model,user_id) AS hi, min(score) OVER (PARTITION BY model,user_id) AS lo FROM preds)) GROUP BY 1,2"""
MODEL_ROUNDED = "SELECT user_id, item_id, " + ", ".join(
    f"round({m}_norm_score,6) AS {m}_norm_score, {m}_rank, {m}_in_top10" for m in MODELS
) + ", CAST(freq_in_top10+recency_in_top10+spend_in_top10 AS INTEGER) AS n_models_in_top10 FROM wide"


@query("attach_model_scores", on_preds(MODEL_ROUNDED, f"wide AS ({MODEL_WIDE})"))
def attach_model_scores(spark, sf):
    return rounded(features.attach_model_scores(preds(parts(spark, sf).train), MODELS))


@query(
    "attach_history",
    on_preds("""SELECT user_id, item_id, coalesce(ui_total_events,0) AS ui_total_events, coalesce(ui_days_since_last,999) AS ui_days_since_last, coalesce(ui_view,0) AS ui_view,
      coalesce(ui_cart,0) AS ui_cart, coalesce(ui_purchase,0) AS ui_purchase FROM (SELECT user_id, item_id FROM gt) LEFT JOIN hist USING (user_id,item_id)""", f"hist AS ({PAIR_HIST})"),
)
def attach_history(spark, sf):
    p = parts(spark, sf)
    return rounded(features.attach_history(p.gt, features.user_item_history(p.train)))


@query(
    "attach_affinity",
    on_split(f"""SELECT user_id, item_id, ub.brand AS user_top_brand, ib.brand AS item_brand, CAST(coalesce(ub.brand=ib.brand,false) AS INTEGER) AS brand_match,
      CAST(coalesce(uc.category_code=ic.category_code,false) AS INTEGER) AS category_match FROM gt
      LEFT JOIN {mode_of('train','user_id','brand')} ub USING (user_id) LEFT JOIN {mode_of('train','user_id','category_code')} uc USING (user_id)
      LEFT JOIN {mode_of('train','item_id','brand')} ib USING (item_id) LEFT JOIN {mode_of('train','item_id','category_code')} ic USING (item_id)"""),
)
def attach_affinity(spark, sf):
    p = parts(spark, sf)
    users, items = features.affinity_top1(p.train)
    return features.attach_affinity(p.gt, users, items).select(
        "user_id", "item_id", "user_top_brand", "item_brand", "brand_match", "category_match"
    )


@query(
    "attach_label",
    on_preds("""SELECT user_id, item_id, CASE WHEN g.user_id IS NULL THEN 0 ELSE 1 END AS label, CASE WHEN user_id IN (SELECT user_id FROM gt) THEN 1 ELSE 0 END AS is_eval_user
      FROM (SELECT DISTINCT user_id, item_id FROM preds) c LEFT JOIN gt g USING (user_id, item_id)""".replace("g.user_id IS NULL", "g.item_id IS NULL")),
)
def attach_label(spark, sf):
    p = parts(spark, sf)
    return features.attach_label(features.candidate_pool(preds(p.train)), p.truth, p.users)


CANDIDATES = f"""SELECT w.*, CAST(freq_in_top10+recency_in_top10+spend_in_top10 AS INTEGER) AS n_models_in_top10, i.* EXCLUDE (item_id), u.* EXCLUDE (user_id), h.* EXCLUDE (user_id,item_id),
  ub.brand AS user_top_brand, ib.brand AS item_brand, uc.category_code AS user_top_category, ic.category_code AS item_category,
  CAST(coalesce(ub.brand=ib.brand,false) AS INTEGER) AS brand_match, CAST(coalesce(uc.category_code=ic.category_code,false) AS INTEGER) AS category_match,
  CASE WHEN g.item_id IS NULL THEN 0 ELSE 1 END AS label, CASE WHEN w.user_id IN (SELECT user_id FROM gt) THEN 1 ELSE 0 END AS is_eval_user
  FROM wide w LEFT JOIN ({ITEM_POP}) i ON i.item_id=w.item_id LEFT JOIN ({USER_ACT}) u ON u.user_id=w.user_id LEFT JOIN ({PAIR_HIST}) h ON h.user_id=w.user_id AND h.item_id=w.item_id
  LEFT JOIN {mode_of('train','user_id','brand')} ub ON ub.user_id=w.user_id LEFT JOIN {mode_of('train','user_id','category_code')} uc ON uc.user_id=w.user_id
  LEFT JOIN {mode_of('train','item_id','brand')} ib ON ib.item_id=w.item_id LEFT JOIN {mode_of('train','item_id','category_code')} ic ON ic.item_id=w.item_id
  LEFT JOIN gt g ON g.user_id=w.user_id AND g.item_id=w.item_id"""
WIDE_ROUNDED = MODEL_ROUNDED.replace(", CAST(freq_in_top10+recency_in_top10+spend_in_top10 AS INTEGER) AS n_models_in_top10 FROM wide", " FROM wide0")


@query("candidate_features", on_preds(CANDIDATES, f"wide0 AS ({MODEL_WIDE})", f"wide AS ({WIDE_ROUNDED})"))
def candidate_features(spark, sf):
    p = parts(spark, sf)
    return rounded(features.candidate_features(preds(p.train), MODELS, p.train, p.truth, p.users))


@query(
    "feature_columns",
    on_preds("""SELECT feature, count(*) AS n, round(avg(value),3) AS mean FROM (UNPIVOT (SELECT COLUMNS(* EXCLUDE (user_id,item_id,label,is_eval_user,user_top_brand,item_brand,user_top_category,item_category))::DOUBLE FROM cand)
      ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY 1""", f"wide0 AS ({MODEL_WIDE})", f"wide AS ({WIDE_ROUNDED})", f"cand AS ({CANDIDATES})"),
)
def feature_columns(spark, sf):
    """Mean of every numeric feature: all columns but ids, labels and text."""
    from basketry.functions.scalars import feature_columns as numeric

    p = parts(spark, sf)
    table = rounded(features.candidate_features(preds(p.train), MODELS, p.train, p.truth, p.users))
    names = numeric(table)
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return table.select(F.inline(cells)).groupBy("feature").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 3).alias("mean")
    )


@query(
    "missing_sentinels",
    on_preds("""SELECT user_id, item_id, coalesce(f.rank,60) AS freq_rank, CASE WHEN f.rank<=10 THEN 1 ELSE 0 END AS freq_in_top10
       FROM gt LEFT JOIN (SELECT user_id, item_id, rank FROM preds WHERE model='freq') f USING (user_id, item_id)"""),
)
def missing_sentinels(spark, sf):
    from basketry.functions.scalars import fill_candidate_nulls

    p = parts(spark, sf)
    ranks = one_model(p.train, "freq").select(
        "user_id", "item_id", F.col("rank").alias("freq_rank"), (F.col("rank") <= 10).cast("int").alias("freq_in_top10")
    )
    return fill_candidate_nulls(p.gt.join(ranks, ["user_id", "item_id"], "left"), 50)


@query("write_features", on_split(PAIR_HIST))
def write_features(spark, sf):
    path = scratch_path(spark, "features")
    tables.write_features(rounded(features.user_item_history(parts(spark, sf).train)), path)
    return spark.read.parquet(path)


@query("write_catalog", on_log(f"SELECT item_id, total_events, recent14_events, brand, category_l2, price FROM ({CATALOG})"))
def write_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    catalog = rounded(features.item_catalog(fixtures.activity_log(spark, sf)))
    columns = ["item_id", "total_events", "recent14_events", "brand", "category_l2", "price"]
    tables.write_catalog(catalog, path)
    return spark.read.schema(catalog.schema).json(path).select(*columns)


USER_TOP = """(SELECT user_id, string_agg({c},'|' ORDER BY r) AS {name} FROM (SELECT user_id, {e} AS {c}, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {e}) AS r
  FROM log WHERE event_type='view' AND {e} IS NOT NULL GROUP BY user_id, {e}) WHERE r<=3 GROUP BY 1)"""
FIRST_BRANDS = """(SELECT user_id, string_agg(brand,'|' ORDER BY r) AS {name} FROM (SELECT user_id, brand, row_number() OVER (PARTITION BY user_id ORDER BY min(event_time), min(event_id)) AS r
  FROM log WHERE event_type='{t}' AND brand IS NOT NULL GROUP BY user_id, brand) {cap} GROUP BY 1)"""
CONTEXT = f"""SELECT user_id, total_events, recent14_events, coalesce(top_categories,'') AS top_categories, coalesce(top_brands,'') AS top_brands, coalesce(carted_brands,'') AS carted_brands,
  coalesce(purchased_brands,'') AS purchased_brands, round(m,6) AS price_median, round(a,6) AS price_p25, round(z,6) AS price_p75, round(z-a,6) AS price_iqr
  FROM (SELECT user_id, count(*) AS total_events, count(*) FILTER (WHERE {RECENT}) AS recent14_events FROM log GROUP BY 1)
  LEFT JOIN {USER_TOP.format(c='cl2', e=L2PATH, name='top_categories')} USING (user_id) LEFT JOIN {USER_TOP.format(c='b', e='brand', name='top_brands')} USING (user_id)
  LEFT JOIN {FIRST_BRANDS.format(t='cart', name='carted_brands', cap='WHERE r<=5')} USING (user_id) LEFT JOIN {FIRST_BRANDS.format(t='purchase', name='purchased_brands', cap='WHERE r<=5')} USING (user_id)
  LEFT JOIN (SELECT user_id, median(price) AS m, quantile_cont(price,0.25) AS a, quantile_cont(price,0.75) AS z FROM log WHERE event_type='view' AND price IS NOT NULL GROUP BY 1) USING (user_id)"""


def flat_context(df):
    lists = ["top_categories", "top_brands", "carted_brands", "purchased_brands"]
    return rounded(df.withColumns({c: F.array_join(c, "|") for c in lists}))


@query("user_context", on_log(CONTEXT))
def user_context(spark, sf):
    return flat_context(context.user_context(fixtures.activity_log(spark, sf)))


@query("user_profile", on_log(CONTEXT.replace("WHERE r<=5", "")))
def user_profile(spark, sf):
    return flat_context(context.user_profile(fixtures.activity_log(spark, sf)))


@query(
    "user_profile_active",
    on_log("SELECT * FROM (" + CONTEXT.replace("WHERE r<=5", "") + ") WHERE user_id IN (SELECT user_id FROM act)",
           "act AS (SELECT user_id FROM log WHERE event_type IN ('cart','purchase') GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 10)"),
)
def user_profile_active(spark, sf):
    log = fixtures.activity_log(spark, sf)
    chosen = context.choose_users(log, active_top=10)
    return flat_context(context.user_profile(log).join(chosen, "user_id", "left_semi"))


@query(
    "user_profile_items",
    on_log(f"""SELECT user_id, item_id, {cnt('cart')}>0 AS carted, {cnt('purchase')}>0 AS purchased FROM log GROUP BY 1,2"""),
)
def user_profile_items(spark, sf):
    return context.profile_items(fixtures.activity_log(spark, sf)).select("user_id", "item_id", "carted", "purchased")


@query(
    "user_profile_lists",
    on_log("""SELECT user_id, kind, CAST(pos//7 AS BIGINT) AS chunk, string_agg(CAST(item_id AS VARCHAR),'|' ORDER BY pos) AS items FROM (
      SELECT user_id, kind, item_id, row_number() OVER (PARTITION BY user_id, kind ORDER BY item_id)-1 AS pos FROM (
       SELECT DISTINCT user_id, 'seen' AS kind, item_id FROM log UNION ALL SELECT DISTINCT user_id, 'carted', item_id FROM log WHERE event_type='cart'
       UNION ALL SELECT DISTINCT user_id, 'purchased', item_id FROM log WHERE event_type='purchase')) GROUP BY 1,2,3"""),
)
def user_profile_lists(spark, sf):
    lists = context.profile_lists(fixtures.activity_log(spark, sf), chunk=7)
    return lists.select("user_id", "kind", "chunk", F.array_join(F.transform("items", lambda i: i.cast("string")), "|").alias("items"))


@query(
    "event_history",
    on_shop("""SELECT user_id, CAST(pos//20 AS BIGINT) AS chunk, string_agg(item_id||':'||event_type||':'||d,'|' ORDER BY pos) AS events FROM (
      SELECT user_id, item_id, event_type, CAST(floor((epoch_us((SELECT max(event_time) FROM shop))-epoch_us(event_time))/86400e6) AS INTEGER) AS d,
       row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id)-1 AS pos FROM shop) GROUP BY 1,2"""),
)
def event_history(spark, sf):
    history = context.event_history(shop(spark, sf), chunk=20)
    text = F.transform("events", lambda e: F.concat_ws(":", e["item_id"].cast("string"), e["event_type"], e["days_ago"].cast("string")))
    return history.select("user_id", "chunk", F.array_join(text, "|").alias("events"))


@query("save_profiles", on_log("SELECT * FROM (" + CONTEXT.replace("WHERE r<=5", "") + ")"))
def save_profiles(spark, sf):
    profile = flat_context(context.user_profile(fixtures.activity_log(spark, sf)))
    path = scratch_path(spark, "profiles")
    tables.save_profiles(profile.withColumn("total_events", F.lit(0).cast("long")), path)
    tables.save_profiles(profile, path)
    return tables.load_profiles(spark, path)
