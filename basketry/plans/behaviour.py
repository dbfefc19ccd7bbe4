"""Queries over descriptive statistics and conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.scalars import category_path, rare_to_unk
from basketry.operators import behaviour as B
from basketry.operators import conversion as C
from basketry.operators import windows
from basketry.operators.splits import cutoff_time
from basketry.plans.common import rounded, shop
from basketry.plans.registry import query
from basketry.plans.scalars import PRICE_CASE, PRICE_EDGES, PRICE_LABELS
from basketry.plans.sqlbase import DESCRIBE, L2PATH, L2TOKEN, cnt, mode_of, on_log, on_orders, on_shop
from basketry.sources import fixtures

START = "2024-01-25"


def d(value: str) -> str:
    return DESCRIBE.format(v=value)


@query(
    "dataset_profile",
    on_log("""SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(DISTINCT user_session) AS n_sessions,
      count(DISTINCT (user_id,item_id)) AS n_pairs, count(DISTINCT category_code) AS n_categories, count(DISTINCT brand) AS n_brands, count(DISTINCT event_type) AS n_event_types,
      min(event_time) AS first_time, max(event_time) AS last_time, count(*) FILTER (WHERE category_code IS NULL) AS null_category_code, count(*) FILTER (WHERE brand IS NULL) AS null_brand,
      count(*) FILTER (WHERE price IS NULL) AS null_price, round(1-count(*)*1.0/(count(DISTINCT user_id)*count(DISTINCT item_id)),6) AS sparsity,
      round(count(DISTINCT (user_id,item_id))*1.0/(count(DISTINCT user_id)*count(DISTINCT item_id)),6) AS density,
      CAST(floor((epoch_us(max(event_time))-epoch_us(min(event_time)))/86400e6) AS BIGINT) AS n_days FROM log"""),
)
def dataset_profile(spark, sf):
    return rounded(B.dataset_profile(fixtures.activity_log(spark, sf)))


@query("value_counts", on_log("SELECT category_code, count(*) AS n FROM log GROUP BY 1"))
def value_counts(spark, sf):
    return B.value_counts(fixtures.activity_log(spark, sf), "category_code")


DAILY = f"""SELECT strftime(event_time,'%Y-%m-%d') AS date, {cnt('view')} AS view, {cnt('cart')} AS cart, {cnt('purchase')} AS purchase, count(*) AS total,
  round({cnt('purchase')}*100.0/count(*),6) AS purchase_share_pct FROM shop GROUP BY 1"""


@query("daily_event_counts", on_shop(DAILY))
def daily_event_counts(spark, sf):
    return rounded(B.daily_event_counts(shop(spark, sf)))


@query(
    "daily_purchase_price",
    on_orders("""SELECT strftime(event_time,'%Y-%m-%d') AS date, count(*) AS n_purch, round(avg(price),6) AS avg_price, round(median(price),6) AS median_price,
      round(min(price),6) AS min_price, round(max(price),6) AS max_price FROM log WHERE event_type='purchase' GROUP BY 1"""),
)
def daily_purchase_price(spark, sf):
    return rounded(B.daily_purchase_price(fixtures.order_log(spark, sf)))


@query(
    "session_mix",
    on_shop("""SELECT event_type, CAST(sum(n) AS BIGINT) AS n_events, round(avg(n*1.0/t),6) AS mean_share, round(median(n*1.0/t),6) AS median_share,
      count(*) FILTER (WHERE event_type=dom) AS dominant_sessions, count(*) FILTER (WHERE n=t) AS single_type_sessions, count(*) AS n_sessions FROM long GROUP BY 1""",
      f"""s AS (SELECT user_session, {cnt('view')} AS v, {cnt('cart')} AS c, {cnt('purchase')} AS p, count(*) AS t FROM shop GROUP BY 1)""",
      """m AS (SELECT *, CASE WHEN c>=v AND c>=p THEN 'cart' WHEN p>=v AND p>=c THEN 'purchase' ELSE 'view' END AS dom FROM s)""",
      """long AS (SELECT 'view' AS event_type, v AS n, t, dom FROM m UNION ALL SELECT 'cart', c, t, dom FROM m UNION ALL SELECT 'purchase', p, t, dom FROM m)"""),
)
def session_mix(spark, sf):
    return rounded(B.session_mix(shop(spark, sf)))


REPEAT = """SELECT count(*) AS n_users, round(avg(r),6) AS mean_rate, round(avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END),6) AS share_any, round(avg(CASE WHEN r>0.5 THEN 1.0 ELSE 0 END),6) AS share_above_half
  FROM (SELECT user_id, CASE WHEN count(*)>1 THEN 1-count(DISTINCT item_id)*1.0/count(*) ELSE 0 END AS r FROM shop {w} GROUP BY 1)"""


@query("repeat_rate", on_shop(REPEAT.format(w="")))
def repeat_rate(spark, sf):
    return rounded(B.repeat_rate(shop(spark, sf)))


@query("repeat_purchase_rate", on_shop(REPEAT.format(w="WHERE event_type='purchase'")))
def repeat_purchase_rate(spark, sf):
    return rounded(B.repeat_rate(shop(spark, sf), ["purchase"]))


@query(
    "pair_repeat_histogram",
    on_shop("""SELECT events, pairs, round(pairs*1.0/(SELECT sum(pairs) FROM h),6) AS share FROM h WHERE events>1""",
            """h AS (SELECT events, count(*) AS pairs FROM (SELECT user_id, item_id, count(*) AS events FROM shop GROUP BY 1,2) GROUP BY 1)"""),
)
def pair_repeat_histogram(spark, sf):
    return rounded(B.pair_repeat_histogram(shop(spark, sf)))


SHARES = ", round(avg(CASE WHEN size=1 THEN 1.0 ELSE 0 END),6) AS share_1, round(avg(CASE WHEN size<=5 THEN 1.0 ELSE 0 END),6) AS share_le5, round(avg(CASE WHEN size>50 THEN 1.0 ELSE 0 END),6) AS share_gt50"


@query(
    "count_distribution",
    on_orders(f"SELECT 'user' AS key, {d('size')}{SHARES} FROM (SELECT count(*) AS size FROM log GROUP BY user_id) UNION ALL "
              f"SELECT 'item', {d('size')}{SHARES} FROM (SELECT count(*) AS size FROM log GROUP BY item_id) UNION ALL "
              f"SELECT 'session', {d('size')}{SHARES} FROM (SELECT count(*) AS size FROM log GROUP BY user_session) UNION ALL "
              f"SELECT 'sessions per user', {d('size')}{SHARES} FROM (SELECT count(DISTINCT user_session) AS size FROM log GROUP BY user_id)"),
)
def count_distribution(spark, sf):
    log = fixtures.order_log(spark, sf)
    frames = [
        ("user", B.count_distribution(log, "user_id")),
        ("item", B.count_distribution(log, "item_id")),
        ("session", B.count_distribution(log, "user_session")),
        ("sessions per user", B.count_distribution(log, "user_id", "user_session")),
    ]
    out = None
    for name, frame in frames:
        labelled = rounded(frame).select(F.lit(name).alias("key"), "*")
        out = labelled if out is None else out.unionByName(labelled)
    return out


@query(
    "head_coverage",
    on_orders("""SELECT s AS item_share, round(sum(CASE WHEN place < floor(m*s) THEN n ELSE 0 END)*1.0/sum(n),6) AS coverage FROM
      (SELECT n, row_number() OVER (ORDER BY n DESC, item_id)-1 AS place, count(*) OVER () AS m FROM (SELECT item_id, count(*) AS n FROM log GROUP BY 1)), (VALUES (0.01::DOUBLE),(0.1),(0.25),(0.5)) v(s) GROUP BY 1"""),
)
def head_coverage(spark, sf):
    return rounded(B.head_coverage(fixtures.order_log(spark, sf), (0.01, 0.1, 0.25, 0.5)))


@query(
    "popularity_rank",
    on_orders("SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id)-1 AS pop_rank FROM (SELECT item_id, count(*) AS n FROM log GROUP BY 1)"),
)
def popularity_rank(spark, sf):
    return windows.popularity_rank(fixtures.order_log(spark, sf))


@query(
    "time_gaps",
    on_shop(f"""SELECT {d('gap')}, round(stddev_samp(gap)/avg(gap),6) AS cv, count(*) FILTER (WHERE gap<1) AS lt_1d, count(*) FILTER (WHERE gap>=1 AND gap<7) AS d1_7,
      count(*) FILTER (WHERE gap>=7 AND gap<30) AS d7_30, count(*) FILTER (WHERE gap>=30) AS ge_30d FROM g""",
      """g AS (SELECT gap FROM (SELECT (epoch_us(event_time)-lag(epoch_us(event_time)) OVER (PARTITION BY user_id ORDER BY event_time, event_id))/86400e6 AS gap FROM shop) WHERE gap IS NOT NULL)"""),
)
def time_gaps(spark, sf):
    return rounded(B.time_gaps(shop(spark, sf)))


@query(
    "calendar_profile",
    on_shop(f"""SELECT CAST(h AS INTEGER) AS hour, coalesce(v,0) AS view, coalesce(c,0) AS cart, coalesce(p,0) AS purchase, coalesce(v+c+p,0) AS total,
      round(p*1.0/nullif(v+c+p,0),6) AS purchase_rate, coalesce(h=(SELECT k FROM t ORDER BY p DESC, k LIMIT 1),false) AS is_peak FROM range(24) r(h) LEFT JOIN t ON k=h""",
      f"t AS (SELECT hour(event_time) AS k, {cnt('view')} AS v, {cnt('cart')} AS c, {cnt('purchase')} AS p FROM shop GROUP BY 1)"),
)
def calendar_profile(spark, sf):
    return rounded(B.calendar_profile(shop(spark, sf)))


@query(
    "weekday_profile",
    on_shop(f"""SELECT CAST(h AS INTEGER) AS dow, coalesce(v,0) AS view, coalesce(c,0) AS cart, coalesce(p,0) AS purchase, coalesce(v+c+p,0) AS total,
      round(p*1.0/nullif(v+c+p,0),6) AS purchase_rate, coalesce(h=(SELECT k FROM t ORDER BY p DESC, k LIMIT 1),false) AS is_peak FROM range(7) r(h) LEFT JOIN t ON k=h""",
      f"t AS (SELECT isodow(event_time)-1 AS k, {cnt('view')} AS v, {cnt('cart')} AS c, {cnt('purchase')} AS p FROM shop WHERE CAST(event_time AS DATE) NOT BETWEEN DATE '2024-01-27' AND DATE '2024-01-29' GROUP BY 1)"),
)
def weekday_profile(spark, sf):
    return rounded(B.calendar_profile(shop(spark, sf), "dow", ("2024-01-27", "2024-01-29")))


@query(
    "period_lift",
    on_shop("""SELECT event_type, round(avg(n) FILTER (WHERE date BETWEEN '2024-01-18' AND '2024-01-24'),6) AS prior_mean, round(avg(n) FILTER (WHERE date BETWEEN '2024-01-25' AND '2024-01-27'),6) AS period_mean,
      CAST(coalesce(sum(n) FILTER (WHERE date BETWEEN '2024-01-25' AND '2024-01-27'),0) AS BIGINT) AS period_total, CAST(sum(n) AS BIGINT) AS total,
      median(n) FILTER (WHERE date>='2024-01-05' AND date<'2024-01-25') AS baseline_median,
      round(avg(n) FILTER (WHERE date BETWEEN '2024-01-25' AND '2024-01-27')/avg(n) FILTER (WHERE date BETWEEN '2024-01-18' AND '2024-01-24'),6) AS lift,
      round(coalesce(sum(n) FILTER (WHERE date BETWEEN '2024-01-25' AND '2024-01-27'),0)*1.0/sum(n),6) AS period_share FROM long GROUP BY 1""",
      f"daily AS ({DAILY})", "long AS (SELECT date,'view' AS event_type, view AS n FROM daily UNION ALL SELECT date,'cart',cart FROM daily UNION ALL SELECT date,'purchase',purchase FROM daily)"),
)
def period_lift(spark, sf):
    return rounded(B.period_lift(shop(spark, sf), "2024-01-25", "2024-01-27", "2024-01-05"))


@query(
    "price_bins",
    on_log(f"SELECT {PRICE_CASE} AS price_bin, count(*) AS n FROM log WHERE event_type='purchase' GROUP BY 1"),
)
def price_bins(spark, sf):
    return B.price_bins(fixtures.activity_log(spark, sf), PRICE_EDGES, PRICE_LABELS)


@query(
    "price_by_category",
    on_orders(f"SELECT {L2TOKEN} AS cat_l2, count(price) AS n, round(avg(price),6) AS mean_price, round(median(price),6) AS median_price FROM log WHERE event_type='purchase' AND category_code IS NOT NULL GROUP BY 1"),
)
def price_by_category(spark, sf):
    return rounded(B.price_by_category(fixtures.order_log(spark, sf)))


@query(
    "price_by_type",
    on_orders("""SELECT event_type, count(price) AS n, round(avg(price),6) AS mean, round(stddev_samp(price),6) AS std, round(min(price),6) AS min, round(max(price),6) AS max, round(median(price),6) AS median,
      round(quantile_cont(price,0.9),6) AS p90 FROM log GROUP BY 1"""),
)
def price_by_type(spark, sf):
    return rounded(B.price_by_type(fixtures.order_log(spark, sf)))


@query(
    "price_distribution",
    on_orders(f"SELECT {d('price')}, round(quantile_cont(price,0.1),6) AS p10, count(*) FILTER (WHERE price=0) AS zero_price FROM log WHERE event_type='purchase'"),
)
def price_distribution(spark, sf):
    return rounded(B.price_distribution(fixtures.order_log(spark, sf)))


@query(
    "category_purchase_rate",
    on_shop(f"SELECT {L2TOKEN} AS cat_l2, count(*) AS n_events, {cnt('purchase')} AS n_purchases, round({cnt('purchase')}*100.0/count(*),6) AS rate_pct FROM shop WHERE category_code IS NOT NULL GROUP BY 1"),
)
def category_purchase_rate(spark, sf):
    return rounded(B.category_purchase_rate(shop(spark, sf)))


@query(
    "top_purchased",
    on_log("""SELECT brand_mapped, count(*) AS n_purchases FROM (SELECT *, CASE WHEN n<400 THEN 'UNK' ELSE brand END AS brand_mapped FROM log LEFT JOIN (SELECT brand AS b, count(*) AS n FROM log GROUP BY 1) ON b=brand)
      WHERE event_type='purchase' AND brand IS NOT NULL GROUP BY 1 ORDER BY n_purchases DESC, brand_mapped LIMIT 15"""),
)
def top_purchased(spark, sf):
    return B.top_purchased(rare_to_unk(fixtures.activity_log(spark, sf), "brand", 400), "brand_mapped")


@query(
    "top_values_by_period",
    on_log(f"""SELECT period, value, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, value NULLS LAST) AS r FROM
      (SELECT CASE WHEN event_time>='{START}' THEN 'during' ELSE 'before' END AS period, brand AS value, count(*) AS n FROM log WHERE event_type='purchase' GROUP BY 1,2)) WHERE r<=10"""),
)
def top_values_by_period(spark, sf):
    return B.top_values_by_period(fixtures.activity_log(spark, sf), "brand", START)


@query(
    "brand_category_diversity",
    on_orders(f"""SELECT count(*) AS n_brands, count(*) FILTER (WHERE n=1) AS single_category, round(count(*) FILTER (WHERE n=1)*1.0/count(*),6) AS single_share, median(n) AS median,
      round(quantile_cont(n,0.9),6) AS p90, max(n) AS max FROM (SELECT brand, count(DISTINCT {L2PATH}) AS n FROM log WHERE brand IS NOT NULL AND category_code IS NOT NULL GROUP BY 1)"""),
)
def brand_category_diversity(spark, sf):
    return rounded(B.brand_category_diversity(fixtures.order_log(spark, sf)))


@query(
    "brand_set_categories",
    on_log("""SELECT event_type, l1, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, l1) AS r FROM
      (SELECT event_type, coalesce(split_part(category_code,'.',1),'(none)') AS l1, count(*) AS n FROM log WHERE brand IN ('Brand#1','Brand#2','Brand#3','Brand#17') GROUP BY 1,2)) WHERE r<=3"""),
)
def brand_set_categories(spark, sf):
    return B.brand_set_categories(fixtures.activity_log(spark, sf), ["Brand#1", "Brand#2", "Brand#3", "Brand#17"])


@query(
    "price_band_hit",
    on_log("""SELECT count(*) AS n_users, count(*) FILTER (WHERE b BETWEEN q1 AND q3) AS in_iqr, count(*) FILTER (WHERE b BETWEEN m-1.5*(q3-q1) AND m+1.5*(q3-q1)) AS in_band,
      round(count(*) FILTER (WHERE b BETWEEN q1 AND q3)*1.0/nullif(count(*),0),6) AS in_iqr_share, round(count(*) FILTER (WHERE b BETWEEN m-1.5*(q3-q1) AND m+1.5*(q3-q1))*1.0/nullif(count(*),0),6) AS in_band_share
      FROM (SELECT user_id, count(*) AS n, median(price) AS m, quantile_cont(price,0.25) AS q1, quantile_cont(price,0.75) AS q3 FROM log WHERE event_type='view' GROUP BY 1)
      JOIN (SELECT user_id, median(price) AS b FROM log WHERE event_type='purchase' GROUP BY 1) USING (user_id) WHERE n>=5"""),
)
def price_band_hit(spark, sf):
    return rounded(B.price_band_hit(fixtures.activity_log(spark, sf)))


def affinity_sql(column: str, expr: str, base: str) -> str:
    views = mode_of("(SELECT * FROM log WHERE event_type='view')", "user_id", column, expr)
    buys = mode_of("(SELECT * FROM log WHERE event_type='purchase')", "user_id", column, expr)
    return on_log(
        f"""SELECT count(*) AS n_buyers, count(*) FILTER (WHERE v.{column}=b.{column}) AS n_match, round(count(*) FILTER (WHERE v.{column}=b.{column})*1.0/nullif(count(*),0),6) AS match_rate,
        (SELECT median(k) FROM dist) AS median_distinct, round(1/(SELECT median(k) FROM dist),6) AS random_rate FROM v JOIN b USING (user_id)""",
        f"v AS {views}",
        f"b AS {buys}",
        f"dist AS (SELECT user_id, count(DISTINCT {expr}) AS k FROM log WHERE {expr} IS NOT NULL {base} GROUP BY 1)",
    )


@query("affinity_match", affinity_sql("brand", "brand", ""))
def affinity_match(spark, sf):
    return rounded(B.affinity_match(fixtures.activity_log(spark, sf), "brand"))


@query("affinity_match_category", affinity_sql("cat", L2PATH, "AND user_id IN (SELECT user_id FROM b)"))
def affinity_match_category(spark, sf):
    log = fixtures.activity_log(spark, sf).withColumn("cat", category_path(F.col("category_code")))
    return rounded(B.affinity_match(log, "cat", buyers_only=True))


@query(
    "user_conversion_zero",
    on_orders(f"""SELECT count(*) AS n_users, count(*) FILTER (WHERE p=0) AS zero_v2p, count(*) FILTER (WHERE c=0) AS zero_v2c FROM
      (SELECT user_id, {cnt('view')} AS v, {cnt('cart')} AS c, {cnt('purchase')} AS p FROM log GROUP BY 1) WHERE v>=10"""),
)
def user_conversion_zero(spark, sf):
    return B.user_conversion_zero(fixtures.order_log(spark, sf))


SESSION_GAP = """g AS (SELECT * FROM (SELECT (epoch_us(start)-lag(epoch_us("end")) OVER (PARTITION BY user_id ORDER BY start))/60e6 AS minutes FROM
  (SELECT user_id, user_session, min(event_time) AS start, max(event_time) AS "end" FROM log GROUP BY 1,2)) WHERE minutes IS NOT NULL)"""


@query(
    "session_gaps",
    on_log("SELECT count(*) AS n, round(avg(minutes),6) AS mean, round(median(minutes),6) AS median FROM g", SESSION_GAP),
)
def session_gaps(spark, sf):
    return rounded(B.session_gaps(fixtures.activity_log(spark, sf)))


@query(
    "session_gap_buckets",
    on_log("""SELECT CASE WHEN minutes<=5 THEN '0-5min' WHEN minutes<=15 THEN '5-15' WHEN minutes<=30 THEN '15-30' WHEN minutes<=60 THEN '30-60' WHEN minutes<=120 THEN '1-2h'
      WHEN minutes<=360 THEN '2-6h' WHEN minutes<=1440 THEN '6-24h' WHEN minutes<=10080 THEN '1-7d' ELSE '>7d' END AS bucket, count(*) AS n FROM g GROUP BY 1""", SESSION_GAP),
)
def session_gap_buckets(spark, sf):
    return B.session_gap_buckets(fixtures.activity_log(spark, sf))


@query(
    "session_crossing",
    on_log("""SELECT count(*) AS n_pairs, count(*) FILTER (WHERE a=b) AS same_session, count(*) FILTER (WHERE a<>b) AS other_session, round(count(*) FILTER (WHERE a=b)*1.0/count(*),6) AS same_share FROM
      (SELECT user_id, item_id, arg_min(user_session, event_time) FILTER (WHERE event_type='view') AS a, arg_min(user_session, event_time) FILTER (WHERE event_type='purchase') AS b FROM log GROUP BY 1,2) WHERE a IS NOT NULL AND b IS NOT NULL"""),
)
def session_crossing(spark, sf):
    return rounded(C.session_crossing(fixtures.activity_log(spark, sf)))


LENGTHS = "lens AS (SELECT user_id, count(*) AS size FROM log WHERE event_time < (SELECT max(event_time) FROM log) - INTERVAL 7 DAY GROUP BY 1)"


def before_cutoff(spark, sf):
    log = fixtures.activity_log(spark, sf)
    return log.filter(F.col("event_time") < cutoff_time(log))


@query(
    "sequence_length_advice",
    on_log("""SELECT p AS percentile, CAST(floor(quantile_cont) AS INTEGER) AS length, round((SELECT avg(CASE WHEN size<=floor(quantile_cont) THEN 1.0 ELSE 0 END) FROM lens),6) AS coverage,
      CAST(least(greatest(floor((SELECT quantile_cont(size,0.9) FROM lens)),20),200) AS INTEGER) AS advised_length FROM (
      SELECT 50 AS p, quantile_cont(size,0.5) AS quantile_cont FROM lens UNION ALL SELECT 75, quantile_cont(size,0.75) FROM lens UNION ALL SELECT 90, quantile_cont(size,0.9) FROM lens
      UNION ALL SELECT 95, quantile_cont(size,0.95) FROM lens UNION ALL SELECT 99, quantile_cont(size,0.99) FROM lens)""", LENGTHS),
)
def sequence_length_advice(spark, sf):
    return rounded(B.sequence_lengths(before_cutoff(spark, sf)))


@query(
    "length_coverage",
    on_log("SELECT CAST(t AS INTEGER) AS threshold, round(avg(CASE WHEN size<=t THEN 1.0 ELSE 0 END),6) AS coverage FROM lens, range(5,201,5) r(t) GROUP BY 1", LENGTHS),
)
def length_coverage(spark, sf):
    return rounded(B.length_coverage(before_cutoff(spark, sf)))


@query(
    "active_users",
    on_orders("SELECT user_id, count(*) AS activity FROM log WHERE event_type IN ('cart','purchase') GROUP BY 1 ORDER BY activity DESC, user_id LIMIT 100"),
)
def active_users(spark, sf):
    return B.active_users(fixtures.order_log(spark, sf), 100)


def pairs_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS from_type, '{b}' AS to_type, (SELECT count(*) FROM log x JOIN log y ON x.user_id=y.user_id AND x.item_id=y.item_id AND y.event_time>x.event_time WHERE x.event_type='{a}' AND y.event_type='{b}') AS n_pairs,
      {cnt(a)} AS n_from, round((SELECT count(*) FROM log x JOIN log y ON x.user_id=y.user_id AND x.item_id=y.item_id AND y.event_time>x.event_time WHERE x.event_type='{a}' AND y.event_type='{b}')*100.0/{cnt(a)},6) AS rate_pct FROM log"""


@query(
    "temporal_pairs",
    on_log(" UNION ALL ".join(pairs_sql(a, b) for a, b in (("view", "cart"), ("view", "purchase"), ("cart", "purchase")))),
)
def temporal_pairs(spark, sf):
    return rounded(C.temporal_pairs(fixtures.activity_log(spark, sf)))


BYPASS = """mark AS (SELECT p.user_id, p.item_id, p.event_time, coalesce(c.t < p.event_time,false) AS cart_before FROM (SELECT DISTINCT user_id, item_id, event_time FROM log WHERE event_type='purchase') p
  LEFT JOIN (SELECT user_id, item_id, min(event_time) AS t FROM log WHERE event_type='cart' GROUP BY 1,2) c USING (user_id, item_id))"""
BYPASS_RATES = """count(*) AS n_purchases, count(*) FILTER (WHERE cart_before) AS via_cart, round(count(*) FILTER (WHERE cart_before)*1.0/count(*),6) AS via_cart_rate,
  count(*) FILTER (WHERE NOT cart_before) AS direct, round(1-count(*) FILTER (WHERE cart_before)*1.0/count(*),6) AS direct_rate"""


@query("cart_before_purchase", on_orders("SELECT user_id, item_id, event_time, cart_before FROM mark", BYPASS))
def cart_before_purchase(spark, sf):
    return C.cart_before_purchase(fixtures.order_log(spark, sf))


@query(
    "cart_bypass",
    on_log(f"SELECT CASE WHEN event_time>='{START}' THEN 'during' ELSE 'before' END AS period, {BYPASS_RATES} FROM mark GROUP BY 1 UNION ALL SELECT 'all', {BYPASS_RATES} FROM mark", BYPASS),
)
def cart_bypass(spark, sf):
    return rounded(C.cart_bypass(fixtures.activity_log(spark, sf), START))


@query("cart_bypass_daily", on_log(f"SELECT strftime(event_time,'%Y-%m-%d') AS date, {BYPASS_RATES} FROM mark GROUP BY 1", BYPASS))
def cart_bypass_daily(spark, sf):
    return rounded(C.cart_bypass_daily(fixtures.activity_log(spark, sf)))


LAG = """lagged AS (SELECT p.user_id, p.item_id, p.event_time AS purchase_time, v.t AS first_view, (epoch_us(p.event_time)-epoch_us(v.t))/60e6 AS minutes FROM (SELECT * FROM log WHERE event_type='purchase') p
  LEFT JOIN (SELECT user_id, item_id, min(event_time) AS t FROM log WHERE event_type='view' GROUP BY 1,2) v USING (user_id, item_id))"""


@query(
    "first_view_to_purchase",
    on_log("SELECT user_id, item_id, purchase_time, first_view, round(minutes,6) AS minutes FROM lagged", LAG),
)
def first_view_to_purchase(spark, sf):
    return rounded(C.first_view_to_purchase(fixtures.activity_log(spark, sf)))


@query(
    "purchase_lag",
    on_log(f"""SELECT CASE WHEN purchase_time>='{START}' THEN 'during' ELSE 'before' END AS period, count(*) AS n_purchases, round(avg(minutes),5) AS mean, round(quantile_cont(minutes,0.25),5) AS p25,
      round(median(minutes),5) AS p50, round(quantile_cont(minutes,0.75),5) AS p75 FROM lagged GROUP BY 1""", LAG),
)
def purchase_lag(spark, sf):
    lag = C.purchase_lag(fixtures.activity_log(spark, sf), START)
    return lag.select("period", "n_purchases", *[F.round(c, 5).alias(c) for c in ("mean", "p25", "p50", "p75")])


@query(
    "new_user_rate",
    on_orders("""SELECT strftime(event_time,'%Y-%m-%d') AS date, count(*) AS n_purch, count(*) FILTER (WHERE CAST(event_time AS DATE)=f) AS n_new_user, round(count(*) FILTER (WHERE CAST(event_time AS DATE)=f)*1.0/count(*),6) AS new_user_rate
      FROM log JOIN (SELECT user_id, CAST(min(event_time) AS DATE) AS f FROM log GROUP BY 1) USING (user_id) WHERE event_type='purchase' GROUP BY 1"""),
)
def new_user_rate(spark, sf):
    return rounded(C.new_user_rate(fixtures.order_log(spark, sf)))


@query(
    "funnel_pairs",
    on_log("""SELECT count(v) AS view_pairs, count(*) FILTER (WHERE c>v) AS view_to_cart, count(*) FILTER (WHERE p>v) AS view_to_purchase, count(c) AS cart_pairs, count(*) FILTER (WHERE p>c) AS cart_to_purchase FROM
      (SELECT user_id, item_id, min(event_time) FILTER (WHERE event_type='view') AS v, min(event_time) FILTER (WHERE event_type='cart') AS c, min(event_time) FILTER (WHERE event_type='purchase') AS p FROM log GROUP BY 1,2)"""),
)
def funnel_pairs(spark, sf):
    return C.funnel_pairs(fixtures.activity_log(spark, sf))


CONV = f"""conv AS (SELECT item_id, median(price) AS price_med, any_value(l.cat_l2) AS cat_l2, any_value(b.brand) AS brand, {cnt('view')} AS n_view, {cnt('cart')} AS n_cart, {cnt('purchase')} AS n_purchase,
  {cnt('cart')}>0 AS ever_cart, {cnt('view')}>0 AS ever_view FROM log LEFT JOIN {mode_of('log','item_id','cat_l2',L2TOKEN)} l USING (item_id) LEFT JOIN {mode_of('log','item_id','brand')} b USING (item_id) GROUP BY 1)"""


@query(
    "item_conversion_meta",
    on_orders("SELECT item_id, round(price_med,6) AS price_med, cat_l2, brand, n_view, n_cart, n_purchase, ever_cart, ever_view FROM conv", CONV),
)
def item_conversion_meta(spark, sf):
    return rounded(C.item_conversion_meta(fixtures.order_log(spark, sf)))


@query(
    "cart_experience",
    on_orders("""SELECT CASE WHEN ever_cart THEN 'carted' ELSE 'view only' END AS kind, count(*) AS n_items, round(median(price_med),6) AS median_price, median(n_view) AS median_views FROM conv WHERE ever_cart OR ever_view GROUP BY 1""", CONV),
)
def cart_experience(spark, sf):
    return rounded(C.cart_experience(C.item_conversion_meta(fixtures.order_log(spark, sf))))


@query(
    "category_cart_rate",
    on_log("SELECT cat_l2, count(*) AS n_items, round(avg(CASE WHEN ever_cart THEN 1.0 ELSE 0 END),6) AS cart_rate, round(median(price_med),6) AS price_med FROM conv WHERE n_view>=2 AND cat_l2 IS NOT NULL GROUP BY 1", CONV),
)
def category_cart_rate(spark, sf):
    return rounded(C.category_cart_rate(fixtures.activity_log(spark, sf), 2))


@query(
    "prior_history_share",
    on_orders("""SELECT count(*) AS n_buyers, count(*) FILTER (WHERE v) AS with_view, count(*) FILTER (WHERE NOT k) AS without_history FROM
      (SELECT user_id, bool_or(event_type='purchase' AND event_time>='1996-01-01' AND event_time<'1996-07-01') AS b, bool_or(event_type='view' AND event_time<'1996-01-01') AS v, bool_or(event_time<'1996-01-01') AS k FROM log GROUP BY 1) WHERE b"""),
)
def prior_history_share(spark, sf):
    return C.prior_history_share(fixtures.order_log(spark, sf), "1996-01-01", "1996-07-01")
