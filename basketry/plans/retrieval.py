"""Queries over retrieval models."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.scalars import BEHAVIOR_WEIGHTS
from basketry.operators import als, context, features, linear, neighbors, tifu, vectors
from basketry.plans.common import parts, rounded
from basketry.plans.features import CATALOG
from basketry.plans.registry import query
from basketry.plans.sqlbase import cnt, on_log, on_split
from basketry.runtime import cut
from basketry.sources import fixtures

K = 30


def tifu_ctes(source: str = "train", weight: str = "1.0") -> str:
    """Oracle of the decayed frequencies, as common table expressions ending in ``vec``."""
    return f"""pos AS (SELECT user_id, item_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_time,event_id)-1 AS t, count(*) OVER (PARTITION BY user_id) AS l FROM {source} WHERE event_type IN ('view','cart','purchase')),
 grp AS (SELECT *, least(7,l) AS gn, l::DOUBLE/least(7,l) AS size FROM pos), grp2 AS (SELECT *, least(CAST(floor(t/size) AS BIGINT), gn-1) AS g FROM grp),
 grp3 AS (SELECT *, CAST(floor(g*size) AS BIGINT) AS s, CASE WHEN g<gn-1 THEN CAST(floor((g+1)*size) AS BIGINT) ELSE l END AS e FROM grp2),
 vec AS (SELECT user_id, item_id, round(sum(pow(0.7,gn-1-g)*pow(0.9,greatest(1,e-s)-1-(t-s))*{weight}),9) AS weight FROM grp3 GROUP BY 1,2)"""


MB = "CASE event_type WHEN 'view' THEN 1.0 WHEN 'cart' THEN 3.0 ELSE 5.0 END::DOUBLE"


def knn_ctes(k: int) -> str:
    return f"""nrm AS (SELECT user_id, sqrt(sum(weight*weight)) AS n FROM vec GROUP BY 1), unt AS (SELECT user_id, item_id, round(weight/n,12) AS w FROM vec JOIN nrm USING (user_id)),
 sims AS (SELECT a.user_id, b.user_id AS neighbor, round(sum(a.w*b.w),9) AS sim FROM unt a JOIN unt b ON a.item_id=b.item_id AND a.user_id<>b.user_id GROUP BY 1,2),
 knn AS (SELECT user_id, neighbor, sim, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, neighbor) AS r FROM sims WHERE sim>0) WHERE r<={k})"""


def score_cte(k: int) -> str:
    return f"""sc AS (SELECT user_id, item_id, round(sum(p),9) AS score FROM (SELECT user_id, item_id, 0.7*weight AS p FROM vec
   UNION ALL SELECT k.user_id, v.item_id, sum(v.weight)*(0.3/{k}) FROM knn k JOIN vec v ON v.user_id=k.neighbor GROUP BY 1,2) GROUP BY 1,2),
 ranked AS (SELECT user_id, item_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC,item_id) AS r FROM sc WHERE score>0) WHERE r<=50)"""


@query("tifu_vectors", on_split("SELECT user_id, item_id, weight FROM vec", tifu_ctes()))
def tifu_vectors(spark, sf):
    return tifu.tifu_vectors(parts(spark, sf).train)


@query("tifu_multi_behavior", on_split("SELECT user_id, item_id, weight FROM vec", tifu_ctes(weight=MB)))
def tifu_multi_behavior(spark, sf):
    return tifu.tifu_vectors(parts(spark, sf).train, weights=BEHAVIOR_WEIGHTS)


@query(
    "recency_groups",
    on_split("SELECT user_id, item_id, t AS position, g AS \"group\", t-s AS group_position, round(pow(0.7,gn-1-g)*pow(0.9,greatest(1,e-s)-1-(t-s)),9) AS decay FROM grp3", tifu_ctes()),
)
def recency_groups(spark, sf):
    grouped = tifu.recency_groups(fixtures.shopping(parts(spark, sf).train))
    return grouped.select("user_id", "item_id", "position", "group", "group_position", F.round("decay", 9).alias("decay"))


def knn_of(train, k=K):
    vec = tifu.tifu_vectors(train)
    return vec, neighbors.user_knn(vec, k)


@query("user_knn", on_split("SELECT user_id, neighbor, sim, rank FROM knn", tifu_ctes(), knn_ctes(K)))
def user_knn(spark, sf):
    return knn_of(parts(spark, sf).train)[1]


@query("tifu_scores", on_split("SELECT * FROM ranked", tifu_ctes(), knn_ctes(K), score_cte(K)))
def tifu_scores(spark, sf):
    vec, knn = knn_of(parts(spark, sf).train)
    return tifu.tifu_scores(vec, knn, k=K)


SEEN = f"seen AS (SELECT user_id, item_id, {cnt('cart')}>0 AS carted, {cnt('purchase')}>0 AS purchased FROM log GROUP BY 1,2)"
CF = """cf AS (SELECT user_id, item_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC,item_id) AS r FROM
  (SELECT k.user_id, s.item_id, sum(3.0::DOUBLE*CAST(s.purchased AS INTEGER)+CAST(s.carted AS INTEGER)) AS score FROM knn k JOIN seen s ON s.user_id=k.neighbor WHERE s.purchased OR s.carted GROUP BY 1,2) x
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id=x.user_id AND s.item_id=x.item_id)) WHERE r<=50)"""


@query("cf_from_neighbors", on_split("SELECT * FROM cf", tifu_ctes(), knn_ctes(K), SEEN, CF))
def cf_from_neighbors(spark, sf):
    p = parts(spark, sf)
    return neighbors.cf_from_neighbors(knn_of(p.train)[1], context.profile_items(p.log))


def weights_of(spark, sf):
    return features.interaction_matrix(parts(spark, sf).train, BEHAVIOR_WEIGHTS)


INTER = "inter AS (SELECT user_id, item_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 3 ELSE 5 END)::DOUBLE AS weight FROM train WHERE event_type IN ('view','cart','purchase') GROUP BY 1,2)"


@query(
    "item_gram",
    on_split("SELECT a.item_id AS item_i, b.item_id AS item_j, sum(a.weight*b.weight) AS value FROM inter a JOIN inter b USING (user_id) GROUP BY 1,2", INTER),
)
def item_gram(spark, sf):
    return linear.item_gram(weights_of(spark, sf), block=16)


@query("item_ridge")
def item_ridge(spark, sf):
    return linear.item_ridge(linear.item_gram(weights_of(spark, sf)), block=64)


# The weights solve their regressions and no item votes for itself.
RIDGE_SOLVED = on_split("SELECT DISTINCT item_id AS item_j, true AS solved, true AS no_own_vote FROM train WHERE event_type IN ('view','cart','purchase')")


@query("item_ridge_residual", RIDGE_SOLVED)
def item_ridge_residual(spark, sf):
    gram = cut(linear.item_gram(weights_of(spark, sf)))
    weights = cut(linear.item_ridge(gram, block=64))
    own = weights.filter("item_i = item_j").select("item_j").distinct().withColumn("own", F.lit(True))
    solved = (F.col("residual") < 1e-6).alias("solved")
    return linear.normal_equations(gram, weights, 200.0).join(own, "item_j", "left").select("item_j", solved, F.col("own").isNull().alias("no_own_vote"))


@query("item_ridge_neighbors")
def item_ridge_neighbors(spark, sf):
    return linear.item_ridge(linear.item_gram(weights_of(spark, sf)), k_neighbors=40)


@query("item_ridge_scores")
def item_ridge_scores(spark, sf):
    inter = weights_of(spark, sf)
    return linear.closed_form(linear.item_gram(inter)).scores(inter)


@query("als_recommend")
def als_recommend(spark, sf):
    p = parts(spark, sf)
    return als.als_recommend(features.interaction_matrix(p.train), p.users, 50)


# Factors are single precision; those of users are fitted last, so they solve their systems for the final item factors.
@query("als_user_equations", on_split("SELECT DISTINCT user_id, true AS solved FROM train WHERE event_type IN ('view','cart','purchase')"))
def als_user_equations(spark, sf):
    inter = cut(features.interaction_matrix(parts(spark, sf).train))
    found = als.user_equations(inter, *als.als_fit(inter))
    return found.select("user_id", (F.col("residual") < 1e-3).alias("solved"))


@query("als_recommend_unseen")
def als_recommend_unseen(spark, sf):
    p = parts(spark, sf)
    return als.als_recommend(features.interaction_matrix(p.train), p.users, 20, filter_seen=True)


@query(
    "embedding_topn",
    """SELECT query_id, item_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM
      (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),9) AS score FROM embeddings a CROSS JOIN embeddings b)) WHERE r<=10""",
)
def embedding_topn(spark, sf):
    table = fixtures.table(spark, sf, "embeddings")
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = table.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return vectors.embedding_topn(queries, items, 10, block=256)


PROFILE = f"""cat AS ({CATALOG}), brands AS (SELECT brand FROM cat WHERE brand IS NOT NULL GROUP BY 1 ORDER BY sum(total_events) DESC, brand LIMIT 20),
 wt AS (SELECT user_id, item_id, sum(CASE event_type WHEN 'view' THEN 0.05 WHEN 'cart' THEN 1.0 ELSE 2.0 END::DOUBLE) AS w FROM log WHERE event_type IN ('view','cart','purchase') GROUP BY 1,2),
 dims AS (SELECT user_id, 'category:'||category_l2 AS item_id, w FROM wt JOIN cat USING (item_id) WHERE category_l2 IS NOT NULL
   UNION ALL SELECT user_id, 'brand:'||brand, w FROM wt JOIN cat USING (item_id) WHERE brand IN (SELECT brand FROM brands)),
 vec AS (SELECT user_id, item_id, round(sum(w),9) AS weight FROM dims GROUP BY 1,2)"""


@query("profile_vectors", on_log("SELECT user_id, item_id AS dim, round(w,6) AS w FROM unt", PROFILE, knn_ctes(20)))
def profile_vectors(spark, sf):
    log = fixtures.activity_log(spark, sf)
    return rounded(vectors.profile_vectors(log, features.item_catalog(log)))


@query("profile_knn", on_log("SELECT user_id, neighbor, sim, rank FROM knn", PROFILE, knn_ctes(20)))
def profile_knn(spark, sf):
    log = fixtures.activity_log(spark, sf)
    return (vectors.profile_knn(vectors.profile_vectors(log, features.item_catalog(log))))
