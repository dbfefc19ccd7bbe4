"""Queries over fusion and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import fusion
from basketry.plans.common import MODELS, parts, preds, rounded
from basketry.plans.ranking import DCG
from basketry.plans.registry import query
from basketry.plans.sqlbase import on_preds
from basketry.runtime import cut

RANKED = "SELECT user_id, item_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM ({0})) WHERE r<=50"
WEIGHTS = {"freq": 3.0, "recency": 1.0, "spend": 2.0}
W_SQL = "CASE model WHEN 'freq' THEN 3.0 WHEN 'recency' THEN 1.0 ELSE 2.0 END::DOUBLE"


@query("rrf", on_preds(RANKED.format(f"SELECT user_id, item_id, round(sum({W_SQL}/(60+rank)),9) AS score FROM preds GROUP BY 1,2")))
def rrf(spark, sf):
    return fusion.rrf(preds(parts(spark, sf).train), weights=WEIGHTS)


@query("rrf_equal", on_preds(RANKED.format("SELECT user_id, item_id, round(sum(1.0::DOUBLE/(60+rank)),9) AS score FROM preds GROUP BY 1,2")))
def rrf_equal(spark, sf):
    return fusion.rrf(preds(parts(spark, sf).train))


@query(
    "weighted_minmax",
    on_preds(RANKED.format(f"SELECT user_id, item_id, round(sum({W_SQL}*ns),9) AS score FROM (SELECT *, CASE WHEN hi>lo THEN (score-lo)/(hi-lo) ELSE 1.0 END AS ns FROM (SELECT *, max(score) OVER (PARTITION BY model,user_id) AS hi, min(score) OVER (PARTITION BY model,user_id) AS lo FROM preds)) GROUP BY 1,2")),
)
def weighted_minmax(spark, sf):
    return fusion.weighted_minmax(preds(parts(spark, sf).train), WEIGHTS)


@query(
    "weighted_zscore",
    on_preds(RANKED.format(f"SELECT user_id, item_id, round(sum({W_SQL}*(score-m)/s),9) AS score FROM preds JOIN (SELECT model, avg(score) AS m, stddev_samp(score) AS s FROM preds GROUP BY 1) USING (model) GROUP BY 1,2")),
)
def weighted_zscore(spark, sf):
    return fusion.weighted_zscore(preds(parts(spark, sf).train), WEIGHTS)


# Single models and the mixes that are compared.
SINGLES = ["freq_only", "recency_only", "spend_only"]
CONFIGS = {
    "freq_only": {"freq": 1.0},
    "recency_only": {"recency": 1.0},
    "spend_only": {"spend": 1.0},
    "f1_r1": {"freq": 1.0, "recency": 1.0},
    "f3_r1": {"freq": 3.0, "recency": 1.0},
    "f5_r1_s1": {"freq": 5.0, "recency": 1.0, "spend": 1.0, "absent": 4.0},
    "f1_r1_s1": {"freq": 1.0, "recency": 1.0, "spend": 1.0},
}
CONFIG_ROWS = ",".join(f"('{c}','{m}',{w}::DOUBLE)" for c, ws in CONFIGS.items() for m, w in ws.items())
SWEEP = [
    f"cfg AS (SELECT * FROM (VALUES {CONFIG_ROWS}) v(config,m,w))",
    "fused AS (SELECT config, user_id, item_id, round(sum(w/(60+rank)),9) AS score FROM preds JOIN cfg ON m=model GROUP BY 1,2,3)",
    "fr AS (SELECT config AS model, user_id, item_id, row_number() OVER (PARTITION BY config,user_id ORDER BY score DESC,item_id) AS rank FROM fused)",
    DCG.replace("FROM preds", "FROM fr"),
    "res AS (SELECT model AS config, round(avg(ndcg),6) AS ndcg, round(avg(recall),6) AS recall FROM usr GROUP BY 1)",
]


def sweep(spark, sf):
    p = parts(spark, sf)
    return rounded(fusion.fusion_sweep(preds(p.train), CONFIGS, cut(p.gt)))


@query("fusion_sweep", on_preds("SELECT config, ndcg, recall FROM res", *SWEEP))
def fusion_sweep(spark, sf):
    return sweep(spark, sf)


@query(
    "best_config",
    on_preds("""SELECT config, ndcg, recall, s AS best_single, round(ndcg-s,6) AS delta, ndcg-s>0 AS improves FROM res, (SELECT max(ndcg) AS s FROM res WHERE config LIKE '%_only') ORDER BY ndcg DESC, length(config) LIMIT 1""", *SWEEP),
)
def best_config(spark, sf):
    return rounded(fusion.best_config(cut(sweep(spark, sf)), SINGLES))


@query(
    "ranked_results",
    on_preds("SELECT config, ndcg, recall, round(ndcg-(SELECT max(ndcg) FROM res WHERE config LIKE '%_only'),6) AS delta FROM res", *SWEEP),
)
def ranked_results(spark, sf):
    return rounded(fusion.ranked_results(cut(sweep(spark, sf)), SINGLES))


def candidates_of(spark, sf):
    from basketry.operators import features

    p = parts(spark, sf)
    lists = preds(p.train)
    return p, lists, cut(features.candidate_features(lists, MODELS, p.train, p.truth, p.users))


def tables_of(spark, sf):
    from basketry.operators import rerank

    p, lists, candidates = candidates_of(spark, sf)
    table, names = rerank.training_table(candidates, folds=3)
    return p, lists, table, names


@query("rerank_binary")
def rerank_binary(spark, sf):
    """With the operator's own settings, as the ranking trees."""
    from basketry.operators import rerank

    _, _, candidates = candidates_of(spark, sf)
    table, _ = rerank.training_table(candidates)
    oof, _ = rerank.rerank_binary(table)
    return rerank.ranked(oof)


@query("rerank_pairwise")
def rerank_pairwise(spark, sf):
    from basketry.operators import rerank

    _, _, table, _ = tables_of(spark, sf)
    oof, _ = rerank.rerank_pairwise(table, 3)
    return rerank.ranked(oof)


@query("score_fold_average")
def score_fold_average(spark, sf):
    from basketry.operators import rerank

    _, _, candidates = candidates_of(spark, sf)
    table, names = rerank.training_table(candidates, folds=3)
    _, models = rerank.rerank_binary(table, 3, trees=5, depth=3)
    return rerank.score_fold_average(rerank.scoring_table(candidates, names), models)


# Scores of trained models are beyond SQL, but every user gets each candidate once, up to fifty.
EVERYONE = on_preds("""SELECT user_id, CAST(least(50, count(*)) AS BIGINT) AS n, CAST(least(50, count(*)) AS INTEGER) AS last_rank
  FROM (SELECT DISTINCT user_id, item_id FROM preds WHERE rank<=50) GROUP BY 1""")


def list_sizes(scores):
    return scores.groupBy("user_id").agg(F.countDistinct("item_id").alias("n"), F.max("rank").alias("last_rank"))


@query("score_everyone", EVERYONE)
def score_everyone(spark, sf):
    return list_sizes(score_fold_average(spark, sf))


@query("score_everyone_pairwise", EVERYONE)
def score_everyone_pairwise(spark, sf):
    from basketry.operators import rerank

    _, _, candidates = candidates_of(spark, sf)
    table, names = rerank.training_table(candidates, folds=3)
    _, models = rerank.rerank_pairwise(table, 3)
    return list_sizes(rerank.score_fold_average(rerank.scoring_table(candidates, names), models))


def lambda_models(spark, sf):
    """Candidates, out-of-fold scores and fold models of the ranking trees, with the operator's own settings."""
    from basketry.operators import ranking_trees, rerank

    p, lists, candidates = candidates_of(spark, sf)
    table, names = rerank.training_table(candidates)
    return p, lists, candidates, ranking_trees.rerank_lambda(table, names)


@query("rerank_lambda")
def rerank_lambda(spark, sf):
    from basketry.operators import rerank

    return rerank.ranked(lambda_models(spark, sf)[3][0])


@query("score_everyone_lambda", EVERYONE)
def score_everyone_lambda(spark, sf):
    from basketry.operators import ranking_trees, rerank

    _, _, candidates, (_, models) = lambda_models(spark, sf)
    return list_sizes(ranking_trees.score_ranking_average(rerank.scoring_table(candidates, models[0].names), models))


# Every evaluable user's candidates are scored out of fold, each by the model that has not seen the user.
LEFT_OUT = on_preds(
    """SELECT fold, count(*) AS n, CAST(sum(bought) AS BIGINT) AS bought FROM (SELECT DISTINCT user_id, item_id FROM preds WHERE rank<=50) c
  JOIN dealt USING (user_id) LEFT JOIN (SELECT user_id, item_id, 1 AS bought FROM gt) USING (user_id, item_id) GROUP BY 1""",
    """dealt AS (SELECT user_id, CAST((row_number() OVER (ORDER BY md5('42:' || user_id), user_id) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT DISTINCT user_id FROM preds WHERE user_id IN (SELECT user_id FROM gt)))""",
)


@query("lambda_left_out", LEFT_OUT)
def lambda_left_out(spark, sf):
    oof = lambda_models(spark, sf)[3][0]
    return oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("bought"))


# Metrics of given out-of-fold scores, in folds by md5, so that SQL can compute the same.
GIVEN = [
    """dealt AS (SELECT user_id, CAST((row_number() OVER (ORDER BY md5('42:' || user_id), user_id) - 1) % 3 AS INTEGER) AS fold
  FROM (SELECT DISTINCT user_id FROM preds))""",
    "oof AS (SELECT user_id, item_id, fold, round(sum(1.0::DOUBLE/(60+rank)),9) AS score FROM preds JOIN dealt USING (user_id) GROUP BY 1,2,3)",
    "fr AS (SELECT 'oof' AS model, user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC,item_id) AS rank FROM oof UNION ALL SELECT model, user_id, item_id, rank FROM preds WHERE model='freq')",
    DCG.replace("FROM preds", "FROM fr"),
]


def given_scores(spark, sf):
    """Fused scores with a fold per user, in the place of a model's."""
    from basketry.operators.splits import user_folds

    p = parts(spark, sf)
    lists = preds(p.train)
    scores = fusion.rrf(lists, n=1000).select("user_id", "item_id", "score").join(user_folds(lists, 3), "user_id")
    return p, lists, cut(scores)


@query(
    "fold_metrics_given",
    on_preds("SELECT fold, round(avg(ndcg),6) AS ndcg, round(avg(recall),6) AS recall FROM usr JOIN dealt USING (user_id) WHERE model='oof' GROUP BY 1", *GIVEN),
)
def fold_metrics_given(spark, sf):
    from basketry.operators import rerank

    p, _, scores = given_scores(spark, sf)
    return rounded(rerank.fold_metrics(scores, p.gt, 3))


@query(
    "oof_report_given",
    on_preds(
        """SELECT round(a.ndcg,6) AS ndcg, round(a.recall,6) AS recall, round(b.ndcg,6) AS baseline_ndcg, round(b.recall,6) AS baseline_recall,
  round(a.ndcg-b.ndcg,6) AS ndcg_delta, round(a.recall-b.recall,6) AS recall_delta
  FROM (SELECT avg(ndcg) AS ndcg, avg(recall) AS recall FROM usr WHERE model='oof') a, (SELECT avg(ndcg) AS ndcg, avg(recall) AS recall FROM usr WHERE model='freq') b""",
        *GIVEN,
    ),
)
def oof_report_given(spark, sf):
    from basketry.operators import rerank

    p, lists, scores = given_scores(spark, sf)
    return rounded(rerank.oof_report(scores, lists.filter("model = 'freq'").drop("model"), p.gt))


@query("fold_metrics")
def fold_metrics(spark, sf):
    from basketry.operators import rerank

    p, _, table, _ = tables_of(spark, sf)
    oof, _ = rerank.rerank_binary(table, 3, trees=5, depth=3)
    return rerank.fold_metrics(cut(oof), p.gt, 3)


@query("oof_report")
def oof_report(spark, sf):
    from basketry.operators import rerank

    p, lists, table, _ = tables_of(spark, sf)
    oof, _ = rerank.rerank_binary(table, 3, trees=5, depth=3)
    return rerank.oof_report(cut(oof), lists.filter("model = 'freq'").drop("model"), p.gt)


@query("feature_gain")
def feature_gain(spark, sf):
    from basketry.operators import rerank

    _, _, table, names = tables_of(spark, sf)
    _, models = rerank.rerank_binary(table, 3, trees=5, depth=3)
    return rerank.feature_gain(models, names, spark)
