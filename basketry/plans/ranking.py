"""Queries over ranking, submissions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import context, metrics, splits, submission, windows
from basketry.operators.distributed import top_rows
from basketry.plans.common import one_model, parts, preds, rounded
from basketry.plans.registry import query
from basketry.plans.retrieval import K, knn_ctes, score_cte, tifu_ctes
from basketry.plans.sqlbase import L2PATH, on_log, on_preds, on_split
from basketry.runtime import cut
from basketry.sources import fixtures


@query(
    "rank_within_user",
    on_preds("SELECT user_id, item_id, score, rank FROM preds WHERE model='spend' AND rank<=20"),
)
def rank_within_user(spark, sf):
    return windows.rank_within_user(one_model(parts(spark, sf).train, "spend"), 20)


@query(
    "minmax_within_user",
    on_preds("""SELECT model, user_id, item_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score-min(score) OVER w)/(max(score) OVER w-min(score) OVER w) ELSE 1.0 END,6) AS norm_score
      FROM preds WINDOW w AS (PARTITION BY model,user_id)"""),
)
def minmax_within_user(spark, sf):
    scaled = windows.minmax_within_user(preds(parts(spark, sf).train), ("model", "user_id"))
    return rounded(scaled.select("model", "user_id", "item_id", "norm_score"))


@query(
    "zscore_global",
    on_preds("""SELECT model, user_id, item_id, round((score-m)/s,6) AS norm_score FROM preds JOIN (SELECT model, avg(score) AS m, stddev_samp(score) AS s FROM preds GROUP BY 1) USING (model)"""),
)
def zscore_global(spark, sf):
    return rounded(windows.zscore_global(preds(parts(spark, sf).train)).select("model", "user_id", "item_id", "norm_score"))


@query(
    "last_n_events",
    on_log("SELECT event_id, CAST(r AS INTEGER) AS recency FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS r FROM log) WHERE r<=15"),
)
def last_n_events(spark, sf):
    return windows.last_n_events(fixtures.activity_log(spark, sf), 15).select("event_id", "recency")


@query(
    "top_n_per_user",
    on_preds("SELECT model, user_id, item_id, CAST(r AS INTEGER) AS rank FROM (SELECT model, user_id, item_id, row_number() OVER (PARTITION BY model,user_id ORDER BY score DESC,item_id) AS r FROM scored) WHERE r<=5"),
)
def top_n_per_user(spark, sf):
    scores = preds(parts(spark, sf).train).drop("rank")
    return top_rows(scores, ["model", "user_id"], [F.desc("score"), F.asc("item_id")], 5).drop("score")


@query(
    "top_values_per_user",
    on_log(f"""SELECT user_id, value, n, CAST(r AS INTEGER) AS rank FROM (SELECT user_id, {L2PATH} AS value, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {L2PATH}) AS r
      FROM log WHERE event_type='view' AND category_code IS NOT NULL GROUP BY 1,2) WHERE r<=3"""),
)
def top_values_per_user(spark, sf):
    from basketry.functions.scalars import category_path

    views = fixtures.activity_log(spark, sf).filter("event_type = 'view'").withColumn("value", category_path(F.col("category_code")))
    return context.top_values_per_user(views, "value")


FILL = [
    "pop AS (SELECT item_id, count(*) AS n FROM train WHERE event_type='purchase' GROUP BY 1 ORDER BY n DESC, item_id LIMIT 50)",
    "want AS (SELECT c_custkey AS user_id FROM customer)",
    """cand AS (SELECT user_id, item_id, 0 AS src, rank AS ord FROM preds WHERE model='freq' AND rank<=4
       UNION ALL SELECT user_id, item_id, 1, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS INTEGER) FROM want, pop)""",
    "uniq AS (SELECT user_id, item_id, min(src*1000+ord) AS k FROM cand WHERE user_id IN (SELECT user_id FROM want) GROUP BY 1,2)",
    "filled AS (SELECT user_id, item_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS r FROM uniq) WHERE r<=10)",
]


def filled(spark, sf):
    """Short lists of the frequency model for all customers, filled up."""
    train = parts(spark, sf).train
    short = one_model(train, "freq").filter("rank <= 4")
    wanted = fixtures.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return submission.fill_with_popularity(short, wanted, submission.popularity(train, 50)), wanted


@query("fill_with_popularity", on_preds("SELECT user_id, item_id, rank FROM filled", *FILL))
def fill_with_popularity(spark, sf):
    return filled(spark, sf)[0]


@query(
    "validate_submission",
    on_preds("""SELECT 'columns' AS "check", true AS passed, 0 AS found UNION ALL SELECT 'row count', count(*)=10*(SELECT count(*) FROM want), count(*) FROM filled
      UNION ALL SELECT 'user count', count(DISTINCT user_id)=(SELECT count(*) FROM want), count(DISTINCT user_id) FROM filled
      UNION ALL SELECT 'items per user', count(*)=0, count(*) FROM (SELECT user_id FROM filled GROUP BY 1 HAVING count(*)<>10)
      UNION ALL SELECT 'duplicates', count(*)=0, count(*) FROM (SELECT user_id FROM filled GROUP BY 1 HAVING count(*)<>count(DISTINCT item_id))""", *FILL),
)
def validate_submission(spark, sf):
    lists, wanted = filled(spark, sf)
    return submission.validate_submission(lists.select("user_id", "item_id"), wanted.count())


def forecast_ctes(source: str) -> tuple[str, ...]:
    """Oracle of the flagship job over ``source``, as common table expressions ending in ``filled``."""
    return (
        tifu_ctes(source), knn_ctes(K), score_cte(K), "want AS (SELECT DISTINCT user_id FROM log)",
        f"pop AS (SELECT item_id, count(*) AS n FROM {source} WHERE event_type='purchase' GROUP BY 1 ORDER BY n DESC, item_id LIMIT 50)",
        """cand AS (SELECT user_id, item_id, 0 AS src, rank AS ord FROM ranked
         UNION ALL SELECT user_id, item_id, 1, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) FROM want, pop)""",
        "uniq AS (SELECT user_id, item_id, min(src*1000000+ord) AS k FROM cand WHERE src=1 OR ord<=10 GROUP BY 1,2)",
        """filled AS (SELECT user_id, item_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS r FROM uniq) WHERE r<=10)""",
    )


@query("next_week_top10", on_log("SELECT user_id, item_id, rank FROM filled", *forecast_ctes("log")))
def next_week_top10(spark, sf):
    """The job with K neighbours, as its SQL has them; the job's own default is 300."""
    from basketry.plans.next_week import next_week_top10 as job

    return job(fixtures.activity_log(spark, sf), near=K)


@query("next_week_top10_holdout", on_split("SELECT user_id, item_id, rank FROM filled", *forecast_ctes("train")))
def next_week_top10_holdout(spark, sf):
    """Likewise with K neighbours."""
    from basketry.plans.next_week import next_week_top10 as job

    return job(fixtures.activity_log(spark, sf), val_days=7, near=K)


DCG = """top AS (SELECT model, user_id, item_id, rank AS pos FROM preds WHERE rank<=10),
 sizes AS (SELECT user_id, count(*) AS n FROM gt GROUP BY 1),
 ideal AS (SELECT k, sum(1/log2(k+1)) OVER (ORDER BY k) AS v FROM range(1,11) r(k)),
 usr AS (SELECT m.model, s.user_id, coalesce(sum(CASE WHEN g.item_id IS NOT NULL THEN 1/log2(pos+1) END),0)/any_value(i.v) AS ndcg, count(DISTINCT g.item_id)*1.0/any_value(s.n) AS recall,
   coalesce(1.0/min(CASE WHEN g.item_id IS NOT NULL THEN pos END),0) AS rr FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN sizes s JOIN ideal i ON i.k=least(10,s.n)
   LEFT JOIN top t ON t.model=m.model AND t.user_id=s.user_id LEFT JOIN gt g ON g.user_id=t.user_id AND g.item_id=t.item_id GROUP BY 1,2)"""


@query("ndcg_at_k", on_preds("SELECT round(avg(ndcg),6) AS ndcg FROM usr WHERE model='freq'", DCG))
def ndcg_at_k(spark, sf):
    p = parts(spark, sf)
    return rounded(metrics.ndcg_at_k(one_model(p.train, "freq"), p.gt))


@query("recall_at_k", on_preds("SELECT round(avg(recall),6) AS recall FROM usr WHERE model='recency'", DCG))
def recall_at_k(spark, sf):
    p = parts(spark, sf)
    return rounded(metrics.recall_at_k(one_model(p.train, "recency"), p.gt))


@query(
    "mrr_hit_at_k",
    on_preds("SELECT round(avg(rr),6) AS mrr, round(avg(CASE WHEN rr>0 THEN 1.0 ELSE 0 END),6) AS hit_rate FROM usr WHERE model='freq'", DCG),
)
def mrr_hit_at_k(spark, sf):
    p = parts(spark, sf)
    return rounded(metrics.mrr_hit_at_k(one_model(p.train, "freq"), p.gt))


@query("evaluate_models", on_preds("SELECT model, round(avg(ndcg),6) AS ndcg, round(avg(recall),6) AS recall FROM usr GROUP BY 1", DCG))
def evaluate_models(spark, sf):
    p = parts(spark, sf)
    return rounded(metrics.evaluate_models(cut(preds(p.train)), p.gt))


SLICED = """sl AS (SELECT slice, user_id, item_id FROM (SELECT 'full' AS slice, * FROM truth UNION ALL SELECT 'no_spike', * FROM truth WHERE event_time<'2024-01-28' UNION ALL SELECT 'spike_only', * FROM truth WHERE event_time>='2024-01-28'
   UNION ALL SELECT 'later', * FROM truth WHERE event_time>='2030-01-01') WHERE user_id IN (SELECT user_id FROM gt)),
 names AS (SELECT * FROM (VALUES ('full'),('no_spike'),('spike_only'),('later')) v(slice)),
 top AS (SELECT model, user_id, item_id, rank AS pos FROM preds WHERE rank<=10),
 dist AS (SELECT DISTINCT slice, user_id, item_id FROM sl), sizes AS (SELECT slice, user_id, count(*) AS n FROM dist GROUP BY 1,2),
 ideal AS (SELECT k, sum(1/log2(k+1)) OVER (ORDER BY k) AS v FROM range(1,11) r(k)),
 usr AS (SELECT m.model, s.slice, s.user_id, coalesce(sum(CASE WHEN g.item_id IS NOT NULL THEN 1/log2(pos+1) END),0)/any_value(i.v) AS ndcg, count(DISTINCT g.item_id)*1.0/any_value(s.n) AS recall
   FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN sizes s JOIN ideal i ON i.k=least(10,s.n)
   LEFT JOIN top t ON t.model=m.model AND t.user_id=s.user_id LEFT JOIN dist g ON g.slice=s.slice AND g.user_id=t.user_id AND g.item_id=t.item_id GROUP BY 1,2,3),
 res AS (SELECT m.model, n.slice, round(coalesce(avg(ndcg),'nan'::DOUBLE),6) AS ndcg, round(coalesce(avg(recall),'nan'::DOUBLE),6) AS recall, count(u.user_id) AS n_users,
   (SELECT count(*) FROM sl WHERE sl.slice=n.slice) AS n_rows FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN names n LEFT JOIN usr u ON u.model=m.model AND u.slice=n.slice GROUP BY 1,2)"""
WINDOWS = {**splits.default_windows("2024-01-28"), "later": ("2030-01-01", None)}


def slice_results(spark, sf):
    p = parts(spark, sf)
    sliced = splits.val_slices(splits.restrict(p.truth, p.users), WINDOWS)
    return metrics.evaluate_slices(cut(preds(p.train)), sliced, list(WINDOWS))


@query("evaluate_slices", on_preds("SELECT * FROM res", SLICED))
def evaluate_slices(spark, sf):
    return rounded(slice_results(spark, sf))


@query(
    "slice_inflation",
    on_preds("""SELECT model, f AS full_ndcg, s AS no_spike_ndcg, round(f/nullif(s,0),4) AS ratio, round(f-s,5) AS delta FROM
       (SELECT model, max(CASE WHEN slice='full' THEN ndcg END) AS f, max(CASE WHEN slice='no_spike' THEN ndcg END) AS s FROM res WHERE slice IN ('full','no_spike') GROUP BY 1)""", SLICED),
)
def slice_inflation(spark, sf):
    out = rounded(metrics.slice_inflation(rounded(slice_results(spark, sf)).filter("slice in ('full','no_spike')")))
    return out.withColumn("ratio", F.round("ratio", 4)).withColumn("delta", F.round("delta", 5))


PAIRED = DCG + """, served AS (SELECT DISTINCT model, user_id FROM preds),
 ab AS (SELECT a.user_id, a.ndcg AS a_ndcg, b.ndcg AS b_ndcg FROM usr a JOIN usr b ON a.user_id=b.user_id AND a.model='freq' AND b.model='spend'
   WHERE EXISTS (SELECT 1 FROM served s WHERE s.model='freq' AND s.user_id=a.user_id) AND EXISTS (SELECT 1 FROM served s WHERE s.model='spend' AND s.user_id=a.user_id))"""


def paired(spark, sf):
    p = parts(spark, sf)
    return p, metrics.paired_ndcg(cut(one_model(p.train, "freq")), cut(one_model(p.train, "spend")), cut(p.gt))


@query("per_user_ndcg", on_preds("SELECT user_id, round(a_ndcg,6) AS ndcg FROM ab", PAIRED))
def per_user_ndcg(spark, sf):
    p = parts(spark, sf)
    return rounded(metrics.per_user_ndcg(one_model(p.train, "freq"), p.gt))


BINS = """hist AS (SELECT user_id, count(*) AS n, 1-count(DISTINCT item_id)*1.0/count(*) AS r FROM log GROUP BY 1),
 bins AS (SELECT user_id, CASE WHEN r<=0 THEN 'no_repeat (=0)' WHEN r<=0.1 THEN 'low (0-0.1]' WHEN r<=0.3 THEN 'mid (0.1-0.3]' ELSE 'high (>0.3)' END AS repeat_bin,
   CASE WHEN n<=3 THEN '1-3' WHEN n<=6 THEN '4-6' WHEN n<=15 THEN '7-15' WHEN n<=50 THEN '16-50' ELSE '50+' END AS length_bin FROM hist)"""


@query(
    "compare_by_bin",
    on_preds("""SELECT 'repeat' AS kind, repeat_bin AS bin, count(*) AS n_users, round(avg(a_ndcg),6) AS a_ndcg, round(avg(b_ndcg),6) AS b_ndcg, round(avg(a_ndcg)-avg(b_ndcg),6) AS delta FROM ab JOIN bins USING (user_id) GROUP BY 2
      UNION ALL SELECT 'length', length_bin, count(*), round(avg(a_ndcg),6), round(avg(b_ndcg),6), round(avg(a_ndcg)-avg(b_ndcg),6) FROM ab JOIN bins USING (user_id) GROUP BY 2""", PAIRED, BINS),
)
def compare_by_bin(spark, sf):
    p, ab = paired(spark, sf)
    bins = metrics.user_bins(p.log)
    out = None
    for kind, column in (("repeat", "repeat_bin"), ("length", "length_bin")):
        part = metrics.compare_by_bin(ab, bins, column).withColumnRenamed(column, "bin").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


POPBIN = """popr AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id)-1 AS pop_rank FROM log GROUP BY 1)"""


@query("gt_pop_rank", on_preds("SELECT user_id, item_id, pop_rank FROM gt LEFT JOIN popr USING (item_id)", POPBIN))
def gt_pop_rank(spark, sf):
    p = parts(spark, sf)
    return metrics.gt_pop_rank(p.gt, p.log).select("user_id", "item_id", "pop_rank")


@query(
    "hit_rate_by_popularity",
    on_preds("""SELECT CASE WHEN pop_rank<=100 THEN 'top-100' WHEN pop_rank<=1000 THEN '101-1k' WHEN pop_rank<=10000 THEN '1k-10k' ELSE '10k+' END AS pop_bin, count(*) AS n_gt,
      round(avg(CASE WHEN a.item_id IS NULL THEN 0.0 ELSE 1 END),6) AS a_hit_rate, round(avg(CASE WHEN b.item_id IS NULL THEN 0.0 ELSE 1 END),6) AS b_hit_rate,
      round(avg(CASE WHEN a.item_id IS NULL THEN 0.0 ELSE 1 END)-avg(CASE WHEN b.item_id IS NULL THEN 0.0 ELSE 1 END),6) AS delta
      FROM gt g JOIN popr p ON p.item_id=g.item_id LEFT JOIN (SELECT * FROM preds WHERE model='freq' AND rank<=10) a ON a.user_id=g.user_id AND a.item_id=g.item_id
      LEFT JOIN (SELECT * FROM preds WHERE model='spend' AND rank<=10) b ON b.user_id=g.user_id AND b.item_id=g.item_id GROUP BY 1""", POPBIN),
)
def hit_rate_by_popularity(spark, sf):
    p = parts(spark, sf)
    return rounded(metrics.hit_rate_by_popularity(one_model(p.train, "freq"), one_model(p.train, "spend"), p.gt, p.log))


@query(
    "win_loss",
    on_preds("""SELECT count(*) AS n_users, round(avg(d),6) AS mean_delta, round(median(d),6) AS median_delta, round(avg(CASE WHEN d>0 THEN 1.0 ELSE 0 END),6) AS share_a_wins, round(avg(CASE WHEN d<0 THEN 1.0 ELSE 0 END),6) AS share_b_wins,
      round(avg(CASE WHEN d=0 THEN 1.0 ELSE 0 END),6) AS share_ties, round(avg(CASE WHEN d=0 AND a_ndcg=0 THEN 1.0 ELSE 0 END),6) AS share_zero_ties FROM (SELECT a_ndcg, round(a_ndcg-b_ndcg,9) AS d FROM ab)""", PAIRED),
)
def win_loss(spark, sf):
    return rounded(metrics.win_loss(paired(spark, sf)[1]))
