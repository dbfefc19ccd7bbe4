"""Queries over the sections of a user's page."""

from __future__ import annotations

from basketry.operators import carousel as K
from basketry.operators import context, features, vectors
from basketry.operators.splits import time_based_split
from basketry.plans.common import one_model, parts, rounded, shop
from basketry.plans.features import CATALOG
from basketry.plans.registry import query
from basketry.plans.retrieval import CF, PROFILE, SEEN, knn_ctes
from basketry.plans.sqlbase import L2PATH, on_log, on_preds, on_shop
from basketry.runtime import cut
from basketry.sources import fixtures

PROFILES = f"""tcat AS (SELECT user_id, v FROM (SELECT user_id, {L2PATH} AS v, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {L2PATH}) AS r FROM log WHERE event_type='view' AND category_code IS NOT NULL GROUP BY 1,2) WHERE r<=3),
 tbrand AS (SELECT user_id, v FROM (SELECT user_id, brand AS v, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, brand) AS r FROM log WHERE event_type='view' AND brand IS NOT NULL GROUP BY 1,2) WHERE r<=3
   UNION SELECT DISTINCT user_id, brand FROM log WHERE event_type='cart' AND brand IS NOT NULL),
 band AS (SELECT user_id, median(price) AS m, quantile_cont(price,0.75)-quantile_cont(price,0.25) AS iqr FROM log WHERE event_type='view' AND price IS NOT NULL GROUP BY 1),
 usr AS (SELECT DISTINCT user_id FROM log), mlist AS (SELECT user_id, item_id, rank FROM preds WHERE model='freq' AND rank<=10), mlen AS (SELECT user_id, count(*) AS len FROM mlist GROUP BY 1)"""
CONTENT = """csc AS (SELECT u.user_id, i.item_id, round(CASE WHEN EXISTS (SELECT 1 FROM tcat t WHERE t.user_id=u.user_id AND t.v=i.category_l2) THEN 2 ELSE 0 END
    + CASE WHEN EXISTS (SELECT 1 FROM tbrand t WHERE t.user_id=u.user_id AND t.v=i.brand) THEN 2 ELSE 0 END
    + CASE WHEN b.iqr>0 AND abs(i.price-b.m)<=1.5*b.iqr THEN 1 ELSE 0 END + coalesce(1.0::DOUBLE-(ml.rank-1)*1.0/l.len,0.0),9) AS score
   FROM usr u CROSS JOIN cat i LEFT JOIN band b ON b.user_id=u.user_id LEFT JOIN mlist ml ON ml.user_id=u.user_id AND ml.item_id=i.item_id LEFT JOIN mlen l ON l.user_id=u.user_id
   WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id=u.user_id AND s.item_id=i.item_id)),
 cont AS (SELECT user_id, item_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r, max(score) OVER (PARTITION BY user_id) AS best FROM csc) WHERE r<={n} AND (score>0 OR best=0))"""
RECENTPOOL = "pool AS (SELECT item_id, category_l2, recent14_events, CAST(row_number() OVER (ORDER BY recent14_events DESC, item_id) AS INTEGER) AS rank FROM cat WHERE recent14_events>0 QUALIFY rank<={n})"
UNSEEN = """rsc AS (SELECT u.user_id, p.item_id, p.rank AS place, CASE WHEN EXISTS (SELECT 1 FROM tcat t WHERE t.user_id=u.user_id AND t.v=p.category_l2) THEN 200 ELSE 0 END - coalesce(ml.rank-1, l.len, 0) AS score
   FROM usr u CROSS JOIN pool p LEFT JOIN mlist ml ON ml.user_id=u.user_id AND ml.item_id=p.item_id LEFT JOIN mlen l ON l.user_id=u.user_id WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id=u.user_id AND s.item_id=p.item_id)),
 rece AS (SELECT user_id, item_id, score/100.0 AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, place) AS r FROM rsc) WHERE r<={n})"""
REVISIT = """rev0 AS (SELECT *, CAST(floor((epoch_us((SELECT max(event_time) FROM {src}))-epoch_us(event_time))/86400e6) AS INTEGER) AS days FROM {src}),
 rev1 AS (SELECT user_id, item_id, sum(CASE event_type WHEN 'cart' THEN 1.0 WHEN 'view' THEN 0.2 WHEN 'purchase' THEN 0.3 ELSE 0.1 END::DOUBLE/(1.0+days/14.0)) * (1+0.25*least(count(*)-1,3)) AS sc, count(*) AS cntr,
   arg_min(event_type, (days, event_time, event_id)) AS lt, min(days) AS ld, bool_or(event_type='purchase') AS b, bool_or(event_type='purchase' AND days<=7) AS jb FROM rev0 GROUP BY 1,2),
 rev2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sc,9) DESC, item_id) AS r, max(round(sc,9)) OVER (PARTITION BY user_id) AS mx FROM rev1 WHERE NOT jb),
 rev AS (SELECT user_id, item_id, CAST(r AS INTEGER) AS rank, round(round(sc,9)/mx,3) AS revisit_score, lt AS last_event_type, ld AS last_interaction_days, cntr AS revisit_event_count, lt='cart' AND NOT b AS cart_without_purchase FROM rev2 WHERE r<={n})"""


def inputs(spark, sf):
    """Log, profiles, seen items, catalog and model lists; the model is trained before the last week.

    The sections read these tables several times, so each is stored once, as a service would store them.
    """
    log = fixtures.activity_log(spark, sf)
    train, _ = time_based_split(log)
    stored = [
        cut(df)
        for df in (context.user_profile(log), context.profile_items(log), features.item_catalog(log), one_model(train, "freq"))
    ]
    return log, *stored


@query("model_top", on_preds("SELECT user_id, item_id, rank FROM preds WHERE model='freq' AND rank<=10"))
def model_top(spark, sf):
    return K.model_top(one_model(parts(spark, sf).train, "freq"), 10)


@query(
    "recency_pool",
    on_log("SELECT item_id, category_l2, recent14_events, rank FROM pool", f"cat AS ({CATALOG})", RECENTPOOL.format(n=40)),
)
def recency_pool(spark, sf):
    return K.recency_pool(features.item_catalog(fixtures.activity_log(spark, sf)), 40)


BASE = (f"cat AS ({CATALOG})", PROFILES, SEEN)


@query("content_candidates", on_preds("SELECT user_id, item_id, round(score,6) AS score, rank FROM cont", *BASE, CONTENT.format(n=15)))
def content_candidates(spark, sf):
    log, profiles, seen, catalog, pred = inputs(spark, sf)
    return rounded(K.content_candidates(profiles, seen, catalog, K.model_top(pred, 10), 15, user_block=64, item_block=64))


@query("unseen_recent", on_preds("SELECT user_id, item_id, score, rank FROM rece", *BASE, RECENTPOOL.format(n=500), UNSEEN.format(n=20)))
def unseen_recent(spark, sf):
    log, profiles, seen, catalog, pred = inputs(spark, sf)
    return K.unseen_recent(profiles.select("user_id"), profiles, seen, K.recency_pool(catalog), K.model_top(pred, 10), 20)


@query("revisit", on_shop("SELECT * FROM rev", REVISIT.format(src="shop", n=5)))
def revisit(spark, sf):
    return K.revisit(shop(spark, sf), 5)


CAROUSEL = """s0 AS (SELECT user_id, 'submission' AS section, item_id, rank AS position FROM mlist WHERE rank<=5),
 s1 AS (SELECT user_id, 'collaborative' AS section, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INTEGER) AS position FROM cf x WHERE rank<=10 AND NOT EXISTS (SELECT 1 FROM s0 y WHERE y.user_id=x.user_id AND y.item_id=x.item_id) QUALIFY position<=5),
 u1 AS (SELECT user_id, item_id FROM s0 UNION ALL SELECT user_id, item_id FROM s1),
 s2 AS (SELECT user_id, 'content' AS section, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INTEGER) AS position FROM cont x WHERE NOT EXISTS (SELECT 1 FROM u1 y WHERE y.user_id=x.user_id AND y.item_id=x.item_id) QUALIFY position<=5),
 u2 AS (SELECT * FROM u1 UNION ALL SELECT user_id, item_id FROM s2),
 s3 AS (SELECT user_id, 'recency' AS section, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INTEGER) AS position FROM rece x WHERE NOT EXISTS (SELECT 1 FROM u2 y WHERE y.user_id=x.user_id AND y.item_id=x.item_id) QUALIFY position<=5),
 s4 AS (SELECT user_id, 'revisit' AS section, item_id, rank AS position FROM rev WHERE user_id IN (SELECT user_id FROM seen GROUP BY 1 HAVING count(*)>=3)),
 allsec AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)"""


@query(
    "carousel",
    on_preds("SELECT user_id, section, position, item_id FROM allsec", PROFILE, knn_ctes(20), PROFILES, SEEN, CF,
             CONTENT.format(n=15), RECENTPOOL.format(n=500), UNSEEN.format(n=20), "shop AS (SELECT * FROM log WHERE event_type IN ('view','cart','purchase'))", REVISIT.format(src="shop", n=5), CAROUSEL),
)
def carousel(spark, sf):
    log, profiles, seen, catalog, pred = inputs(spark, sf)
    knn = vectors.profile_knn(vectors.profile_vectors(log, catalog))
    return K.carousel(pred, profiles, seen, fixtures.shopping(log), catalog, K.recency_pool(catalog), knn)
