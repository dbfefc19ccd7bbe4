"""Queries over evidence, explanations, checks and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.text import evidence_chips
from basketry.operators import evidence as E
from basketry.operators import gate as G
from basketry.operators import prompts as P
from basketry.operators import windows
from basketry.operators.splits import time_based_split
from basketry.plans.carousel import REVISIT
from basketry.plans.common import one_model, parts, preds, rounded
from basketry.plans.features import CONTEXT, SIGNALS
from basketry.plans.ranking import DCG
from basketry.plans.registry import query
from basketry.plans.sqlbase import SHOP, cnt, mode_of, on_preds, on_split
from basketry.runtime import cut, scratch_path
from basketry.sources import fixtures, tables

LIST = 5

CTX_RAW = CONTEXT.replace("round(m,6)", "m").replace("round(a,6)", "a").replace("round(z,6)", "z").replace("round(z-a,6)", "z-a")
_SIGNAL_SQL = """coalesce(s.item_pop_log1p,0) AS item_pop_log1p, coalesce(s.item_recent14_pop_log1p,0) AS item_recent14_pop_log1p, m.models AS models_recommending, m.ranks AS ranks,
   coalesce(m.hits,0) AS model_hit_count, r.rank AS ensemble_rank, false AS cart_boosted, coalesce(h.viewed,false) AS seen_before, coalesce(h.carted,false) AS carted_before, coalesce(h.purchased,false) AS purchased_before,
   coalesce(list_contains(string_split(c.top_brands||'|'||c.carted_brands||'|'||c.purchased_brands,'|'), s.brand),false) AS brand_affinity, coalesce(list_contains(string_split(c.top_categories,'|'), s.category_l2),false) AS category_l2_affinity,
   coalesce(s.price BETWEEN c.price_median-1.5*c.price_iqr AND c.price_median+1.5*c.price_iqr,false) AS price_in_user_band, abs(s.price-c.price_median)/greatest(abs(c.price_median),1) AS price_distance_to_user_median,
   coalesce(s.item_view_count,0) AS item_view_count, coalesce(s.item_cart_count,0) AS item_cart_count, coalesce(s.item_purchase_count,0) AS item_purchase_count, coalesce(s.item_v2c_smoothed,0) AS item_v2c_smoothed,
   coalesce(s.item_v2p_smoothed,0) AS item_v2p_smoothed, coalesce(s.item_recent14_view_count,0) AS item_recent14_view_count, coalesce(s.item_prev14_view_count,0) AS item_prev14_view_count, coalesce(s.item_recent_trend_ratio,0) AS item_recent_trend_ratio"""
EV = f"""sig AS ({SIGNALS}), ctx AS ({CTX_RAW}), {SHOP}, {REVISIT.format(src='shop', n=LIST + 3)},
 hist AS (SELECT user_id, item_id, {cnt('view')}>0 AS viewed, {cnt('cart')}>0 AS carted, {cnt('purchase')}>0 AS purchased FROM log GROUP BY 1,2),
 mr AS (SELECT user_id, item_id, string_agg(model||'='||rank,'|' ORDER BY model) AS ranks, string_agg(model,'|' ORDER BY model) AS models, CAST(count(*) AS INTEGER) AS hits FROM preds GROUP BY 1,2),
 recs AS (SELECT user_id, item_id, rank FROM preds WHERE model='freq' AND rank<={LIST}),
 again AS (SELECT v.user_id, v.item_id, CAST(row_number() OVER (PARTITION BY v.user_id ORDER BY v.rank)+(SELECT max(rank) FROM recs x WHERE x.user_id=v.user_id) AS INTEGER) AS rank, revisit_score, last_event_type, last_interaction_days, revisit_event_count, cart_without_purchase
   FROM rev v WHERE NOT EXISTS (SELECT 1 FROM recs x WHERE x.user_id=v.user_id AND x.item_id=v.item_id) AND EXISTS (SELECT 1 FROM recs x WHERE x.user_id=v.user_id) QUALIFY row_number() OVER (PARTITION BY v.user_id ORDER BY v.rank)<=3),
 ev AS (SELECT r.user_id, r.rank, r.item_id, s.category_code, s.category_l2, s.brand, s.price, {_SIGNAL_SQL}, CAST(NULL AS DOUBLE) AS revisit_score, CAST(NULL AS VARCHAR) AS last_event_type, CAST(NULL AS INTEGER) AS last_interaction_days, CAST(NULL AS BIGINT) AS revisit_event_count, false AS cart_without_purchase
   FROM recs r LEFT JOIN hist h ON h.user_id=r.user_id AND h.item_id=r.item_id LEFT JOIN sig s ON s.item_id=r.item_id LEFT JOIN ctx c ON c.user_id=r.user_id LEFT JOIN mr m ON m.user_id=r.user_id AND m.item_id=r.item_id
   UNION ALL SELECT r.user_id, r.rank, r.item_id, s.category_code, s.category_l2, s.brand, s.price, {_SIGNAL_SQL}, r.revisit_score, r.last_event_type, r.last_interaction_days, r.revisit_event_count, r.cart_without_purchase
   FROM again r LEFT JOIN hist h ON h.user_id=r.user_id AND h.item_id=r.item_id LEFT JOIN sig s ON s.item_id=r.item_id LEFT JOIN ctx c ON c.user_id=r.user_id LEFT JOIN (SELECT * FROM mr WHERE false) m ON m.user_id=r.user_id AND m.item_id=r.item_id)"""
EV_COLUMNS = ", ".join(
    f"round({c},6) AS {c}"
    if c in ("price", "item_pop_log1p", "item_recent14_pop_log1p", "price_distance_to_user_median", "item_v2c_smoothed", "item_v2p_smoothed", "item_recent_trend_ratio", "revisit_score")
    else f"coalesce({c},'') AS {c}" if c in ("models_recommending", "ranks") else c
    for c in ["user_id", *E.ITEM_FIELDS, *E.SIGNAL_FIELDS]
)


def on_evidence(body: str, *ctes: str) -> str:
    return on_preds(body, EV, *ctes)


def evidence(spark, sf, with_revisit: bool = True):
    log = fixtures.activity_log(spark, sf)
    train, _ = time_based_split(log)
    lists = cut(preds(train))
    recs = lists.filter((F.col("model") == "freq") & (F.col("rank") <= LIST))
    return E.evidence_rows(recs, log, E.model_rank_maps(lists), with_revisit, LIST)


def stored_evidence(spark, sf):
    """The same, stored: checks read evidence both for the responses and for what they are checked against."""
    return cut(evidence(spark, sf))


def flat(rows):
    out = rows.select("user_id", *E.ITEM_FIELDS, *[F.col(f"signals.{c}").alias(c) for c in E.SIGNAL_FIELDS])
    entries = F.transform(F.map_entries("ranks"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rounded(
        out.withColumn("models_recommending", F.array_join("models_recommending", "|")).withColumn("ranks", F.array_join(entries, "|"))
    )


@query("item_evidence", on_evidence(f"SELECT {EV_COLUMNS} FROM ev WHERE revisit_score IS NULL"))
def item_evidence(spark, sf):
    return flat(evidence(spark, sf, with_revisit=False))


@query("evidence_revisit", on_evidence("SELECT user_id, item_id, rank, revisit_score, last_event_type, last_interaction_days, revisit_event_count, cart_without_purchase FROM again"))
def evidence_revisit(spark, sf):
    log = fixtures.activity_log(spark, sf)
    train, _ = time_based_split(log)
    recs = one_model(train, "freq").filter(F.col("rank") <= LIST)
    return E.evidence_revisit(recs, fixtures.shopping(log), longest=LIST)


@query("evidence_pack", on_evidence(f"SELECT {EV_COLUMNS} FROM ev"))
def evidence_pack(spark, sf):
    return flat(E.unpack(E.evidence_pack(evidence(spark, sf))))


@query("evidence_documents", on_evidence(f"SELECT {EV_COLUMNS} FROM ev"))
def evidence_documents(spark, sf):
    packs = E.evidence_pack(evidence(spark, sf))
    path = scratch_path(spark, "packs")
    tables.write_evidence(packs, path)
    return flat(E.unpack(tables.read_evidence(spark, path, packs.schema)))


BOOLS = [c for c in E.SIGNAL_FIELDS if c.endswith(("_before", "_affinity", "_boosted", "_band")) or c == "cart_without_purchase"]
TEXTS = ["models_recommending", "ranks", "last_event_type", "category_code", "category_l2", "brand", "top_categories", "top_brands", "carted_brands", "purchased_brands"]


def support_sql(with_value: bool = False) -> str:
    lines = []
    for key in E.key_names():
        part, name = key.split(".")
        column = f"c.{name}" if part == "user_context" else f"e.{name}"
        test = column if name in BOOLS else f"length({column})>0" if name in TEXTS else f"{column}>0"
        true = f"coalesce({column},false)" if name in BOOLS else "false"
        # Only values that support nothing are shown, and true flags.
        shown = f"CASE WHEN {column} THEN 'True' ELSE 'False' END" if name in BOOLS else f"CASE WHEN typeof({column}) LIKE '%[]' THEN '[]' ELSE chr(39)||chr(39) END" if name in TEXTS else f"CAST({column} AS VARCHAR)"
        value = f", CASE WHEN {column} IS NULL THEN 'None' ELSE {shown} END AS shown" if with_value else ""
        lines.append(f"SELECT e.user_id, e.item_id, '{key}' AS key, coalesce({test},false) AS supported, {true} AS is_true{value} FROM ev e JOIN ctx c USING (user_id)")
    return "val AS (" + " UNION ALL ".join(lines) + ")"


@query("evidence_value", on_evidence("SELECT * FROM val", support_sql()))
def evidence_value(spark, sf):
    return E.evidence_value(evidence(spark, sf))


@query(
    "evidence_keys",
    on_evidence("SELECT key, count(*) FILTER (WHERE supported) AS n_supported FROM val GROUP BY 1", support_sql()),
)
def evidence_keys(spark, sf):
    rows = evidence(spark, sf)
    counts = E.evidence_value(rows).groupBy("key").agg(F.count_if("supported").alias("n_supported"))
    return E.evidence_keys(spark, rows.schema).join(counts, "key", "left")


@query(
    "evidence_chips",
    on_evidence("""SELECT user_id, item_id, array_to_string(list_filter([CASE WHEN item_recent14_pop_log1p>3 THEN '📈 인기↑' END, CASE WHEN model_hit_count>=2 THEN '🤝 모델합의 '||model_hit_count END,
      CASE WHEN revisit_score IS NOT NULL THEN '↩ 재방문' END, CASE WHEN carted_before THEN '🛒 담은적있음' WHEN seen_before THEN '👁 본적있음' END, CASE WHEN purchased_before THEN '✅ 구매이력' END,
      CASE WHEN price_in_user_band THEN '💵 가격대맞음' END, CASE WHEN brand_affinity THEN '🏷 브랜드선호' END, CASE WHEN category_l2_affinity THEN '🧭 카테고리선호' END], lambda x: x IS NOT NULL),'|') AS chips FROM ev"""),
)
def evidence_chips_query(spark, sf):
    rows = evidence(spark, sf)
    return rows.select("user_id", "item_id", F.array_join(evidence_chips(F.col("signals")), "|").alias("chips"))


QUESTION = "CASE WHEN revisit_score IS NOT NULL THEN 'revisit' WHEN rank=1 THEN 'why' WHEN rank=2 THEN 'should_buy' WHEN rank=3 THEN 'fit_preference' WHEN rank=4 THEN 'category_trend' ELSE 'promotion_candidate' END"


def question():
    return (
        F.when(F.col("signals.revisit_score").isNotNull(), "revisit")
        .when(F.col("rank") == 1, "why")
        .when(F.col("rank") == 2, "should_buy")
        .when(F.col("rank") == 3, "fit_preference")
        .when(F.col("rank") == 4, "category_trend")
        .otherwise("promotion_candidate")
    )


def _c(condition: str, text: str, key: str) -> str:
    return f"CASE WHEN {condition} THEN struct_pack(\"text\" := {text}, evidence_ref := '{key}') END"


ABOUT = ", ".join(
    [
        _c("item_recent14_pop_log1p>3.0", "'최근 14일 인기가 높습니다'", "signals.item_recent14_pop_log1p"),
        _c("model_hit_count>=2", "model_hit_count||'개 모델('||replace(array_to_string(string_split(models_recommending,'|')[1:2],'·'),'|','·')||')이 함께 추천했습니다'", "signals.model_hit_count"),
        _c("carted_before", "'이전에 장바구니에 담은 적이 있습니다'", "signals.carted_before"),
        _c("NOT carted_before AND seen_before", "'이전에 본 적이 있는 상품입니다'", "signals.seen_before"),
        _c("price_in_user_band", "'평소 보던 가격대 안에 있습니다'", "signals.price_in_user_band"),
        _c("brand_affinity", "'평소 관심 브랜드('||brand||')와 맞습니다'", "signals.brand_affinity"),
        _c("category_l2_affinity", "'자주 보던 카테고리('||coalesce(category_l2,category_code)||')와 맞습니다'", "signals.category_l2_affinity"),
    ]
)
AGAIN = ", ".join(
    [
        _c("cart_without_purchase", "'장바구니에 담아두셨던 상품입니다'", "signals.cart_without_purchase"),
        _c("last_interaction_days<=7", "'최근 관심 가지셨던 상품입니다'", "signals.last_interaction_days"),
        _c("NOT coalesce(last_interaction_days<=7,false) AND last_event_type IS NOT NULL", "'마지막 상호작용은 '||last_event_type||'였습니다'", "signals.last_event_type"),
        _c("revisit_event_count>=3", "'여러 번 확인하신 상품입니다'", "signals.revisit_event_count"),
        _c("revisit_score IS NOT NULL", "'과거 행동 기준 재방문 점수가 있습니다'", "signals.revisit_score"),
    ]
)
CLAIMS = f"""q AS (SELECT *, {QUESTION} AS question_key FROM ev),
 cl0 AS (SELECT *, CASE WHEN question_key='revisit' THEN list_filter([{AGAIN}], lambda x: x IS NOT NULL) ELSE list_filter([{ABOUT}], lambda x: x IS NOT NULL) END AS l FROM q),
 cl AS (SELECT *, CASE WHEN len(l)>0 THEN l[1:4] WHEN question_key='revisit' THEN [struct_pack("text" := '재방문 이력 기반 후보입니다', evidence_ref := 'recommendation.rank')]
   ELSE [struct_pack("text" := '앙상블 '||rank||'위로 추천되었습니다', evidence_ref := 'recommendation.rank')] END AS claims FROM cl0)"""


def claims_text(column="claims"):
    return F.array_join(F.transform(column, lambda c: F.concat(c["evidence_ref"], F.lit("~"), c["text"])), "|")


CLAIMS_TEXT = "array_to_string(list_transform(claims, lambda x: x.evidence_ref||'~'||x.\"text\"),'|')"


@query("rule_claims", on_evidence(f"SELECT user_id, item_id, question_key, {CLAIMS_TEXT} AS claims FROM cl", CLAIMS))
def rule_claims(spark, sf):
    rows = evidence(spark, sf)
    return rows.select("user_id", "item_id", question().alias("question_key"), claims_text(G.rule_claims(rows, question())).alias("claims"))


RESPONSE = """rp0 AS (SELECT *, len(claims) AS n, coalesce(nullif(brand,''),'이 상품') AS b, coalesce(nullif(category_code,''),'이 카테고리') AS k,
   CASE WHEN question_key='revisit' AND cart_without_purchase THEN least(0.95,least(0.95,0.35+0.13*len(claims))+0.12) ELSE least(0.95,0.35+0.13*len(claims)) END::DOUBLE AS conf FROM cl),
 rp AS (SELECT user_id, item_id, rank, question_key, claims, round(conf,3) AS confidence_raw,
   CASE question_key WHEN 'why' THEN b||'의 '||k||' 상품이며, '||n||'가지 근거가 일치합니다.' WHEN 'should_buy' THEN CASE WHEN n>=2 THEN '근거가 충분해 담아두기를 권합니다.' ELSE '근거가 약하니 조금 더 살펴보세요.' END
     WHEN 'fit_preference' THEN CASE WHEN n>=2 THEN '취향 신호가 일치합니다.' ELSE '취향 일치 신호는 약합니다.' END WHEN 'revisit' THEN CASE WHEN n>=2 THEN '다시 볼 만한 과거 관심 신호가 있습니다.' ELSE '재방문 근거는 제한적입니다.' END
     WHEN 'category_trend' THEN k||' 카테고리에서 최근 조회 추세와 전환 근거를 확인했습니다.' ELSE CASE WHEN n>=2 THEN '조회·전환·취향 신호가 있어 프로모션 후보로 적합합니다.' ELSE '프로모션 후보로는 근거가 약합니다.' END END AS summary,
   CASE question_key WHEN 'should_buy' THEN CASE WHEN conf>0.65 THEN '담아두고 가격 변동 확인' ELSE '추가 조사 권장' END WHEN 'revisit' THEN CASE WHEN conf>0.65 THEN '장바구니 상태와 가격을 다시 확인' ELSE '비슷한 상품과 비교' END
     WHEN 'promotion_candidate' THEN CASE WHEN conf>0.65 THEN '소규모 A/B 실험 권장' ELSE '보류' END ELSE CASE WHEN conf>0.7 THEN '현재 근거로 충분' ELSE '추가 정보 필요' END END AS decision_hint FROM rp0)"""


@query(
    "rule_response",
    on_evidence(f"SELECT user_id, item_id, rank, question_key, summary, {CLAIMS_TEXT} AS claims, decision_hint, confidence_raw FROM rp", CLAIMS, RESPONSE),
)
def rule_response(spark, sf):
    return G.rule_response(evidence(spark, sf), question()).withColumn("claims", claims_text())


FAULTY = """resp AS (SELECT user_id AS pack_user_id, CASE WHEN user_id%5=0 THEN user_id+1 ELSE user_id END AS user_id, CASE WHEN user_id%5=1 THEN -item_id-1 ELSE item_id END AS item_id, rank, question_key, summary, confidence_raw, decision_hint,
   CASE WHEN user_id%5=2 THEN list_concat([struct_pack("text" := claims[1]."text", evidence_ref := 'signals.made_up')], claims[2:])
     WHEN user_id%5=3 THEN list_concat(claims, [struct_pack("text" := 'boosted', evidence_ref := 'signals.cart_boosted')])
     WHEN user_id%5=4 THEN list_transform(claims, lambda x: struct_pack("text" := 'not so: '||x."text", evidence_ref := x.evidence_ref)) ELSE claims END AS claims FROM rp)"""


def faulty_responses(rows):
    """Valid responses with a fault by user: wrong user, unknown item, unknown key, false evidence, negated text."""
    base = G.rule_response(rows, question()).withColumnRenamed("user_id", "pack_user_id")
    fault = F.col("pack_user_id") % 5
    first = F.struct(F.col("claims")[0]["text"].alias("text"), F.lit("signals.made_up").alias("evidence_ref"))
    boosted = F.struct(F.lit("boosted").alias("text"), F.lit("signals.cart_boosted").alias("evidence_ref"))
    negated = F.transform(
        "claims", lambda c: F.struct(F.concat(F.lit("not so: "), c["text"]).alias("text"), c["evidence_ref"].alias("evidence_ref"))
    )
    return base.select(
        "pack_user_id",
        F.when(fault == 0, F.col("pack_user_id") + 1).otherwise(F.col("pack_user_id")).alias("user_id"),
        F.when(fault == 1, -F.col("item_id") - 1).otherwise(F.col("item_id")).alias("item_id"),
        "rank", "question_key", "summary", "confidence_raw", "decision_hint",
        F.when(fault == 2, F.concat(F.array(first), F.slice("claims", 2, 10)))
        .when(fault == 3, F.concat("claims", F.array(boosted)))
        .when(fault == 4, negated)
        .otherwise(F.col("claims"))
        .alias("claims"),
    )


GATE = """chk AS (SELECT r.pack_user_id, r.rank, i, c.evidence_ref AS ref, CASE WHEN v.key IS NULL THEN 'claim['||(i-1)||'] evidence_ref not in whitelist: '||c.evidence_ref WHEN NOT v.supported THEN 'claim['||(i-1)||'] evidence is empty/false at '||c.evidence_ref||': value='||v.shown
    WHEN v.is_true AND regexp_matches(c."text",'(?i)없|아니|\\b(not|no|never)\\b') THEN 'claim['||(i-1)||'] text contradicts '||c.evidence_ref||': value='||v.shown||', text='||CASE WHEN contains(c."text", chr(39)) AND NOT contains(c."text", chr(34)) THEN chr(34)||c."text"||chr(34) ELSE chr(39)||c."text"||chr(39) END END AS f
   FROM (SELECT *, unnest(range(1,len(claims)+1)) AS i, claims[i] AS c FROM resp) r LEFT JOIN val v ON v.user_id=r.pack_user_id AND v.item_id=r.item_id AND v.key=c.evidence_ref
   WHERE EXISTS (SELECT 1 FROM ev e WHERE e.user_id=r.pack_user_id AND e.item_id=r.item_id)),
 fl AS (SELECT pack_user_id, rank, -2 AS o, 'user_id mismatch: '||user_id||' != '||pack_user_id AS f FROM resp WHERE user_id<>pack_user_id
   UNION ALL SELECT pack_user_id, rank, -1, 'item_id not in recommendations: '||item_id FROM resp r WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id=r.pack_user_id AND e.item_id=r.item_id)
   UNION ALL SELECT pack_user_id, rank, i, f FROM chk WHERE f IS NOT NULL),
 fa AS (SELECT pack_user_id, rank, list(f ORDER BY o) AS fs FROM fl GROUP BY 1,2),
 gate AS (SELECT r.pack_user_id, r.rank, r.question_key, coalesce(array_to_string(fs,'|'),'') AS failures, CASE WHEN fs IS NULL THEN 'verified' ELSE 'rejected' END AS badge,
   CASE WHEN fs IS NULL THEN summary ELSE '[검증 실패] '||summary||chr(10)||'오류: '||array_to_string(fs[1:2],'; ') END AS response_text FROM resp r LEFT JOIN fa USING (pack_user_id, rank))"""


@query("hard_gate", on_evidence("SELECT * FROM gate", CLAIMS, RESPONSE, FAULTY, support_sql(True), GATE))
def hard_gate(spark, sf):
    rows = stored_evidence(spark, sf)
    checked = G.hard_gate(faulty_responses(rows), rows)
    return checked.select("pack_user_id", "rank", "question_key", F.array_join("failures", "|").alias("failures"), "badge", "response_text")


SAMPLES = """smp AS (SELECT user_id||':'||item_id AS response_id, s AS sample, list_filter(claims, lambda x, i: (i-1)%3<>s) AS claims FROM rp, (VALUES (0),(1),(2)) v(s)),
 cit AS (SELECT DISTINCT response_id, sample, c.evidence_ref AS ref FROM (SELECT response_id, sample, unnest(claims) AS c FROM smp)),
 shr AS (SELECT a.response_id, a.ref, (SELECT count(*) FROM cit b WHERE b.response_id=a.response_id AND b.ref=a.ref AND b.sample>0)/2.0 AS share FROM cit a WHERE sample=0),
 scr AS (SELECT s.response_id, 3 AS n_samples, coalesce(avg(share),0) AS score FROM (SELECT DISTINCT response_id FROM smp) s LEFT JOIN shr USING (response_id) GROUP BY 1)"""


def samples(rows):
    """Three samples per response; sample s leaves out the claims whose place modulo 3 is s."""
    base = G.rule_response(rows, question()).withColumn(
        "response_id", F.concat_ws(":", F.col("user_id").cast("string"), F.col("item_id").cast("string"))
    )
    exploded = base.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in range(3)])))
    return exploded.withColumn("claims", F.filter("claims", lambda c, i: i % 3 != F.col("sample")))


@query("self_check", on_evidence("SELECT response_id, n_samples, round(score,6) AS score FROM scr", CLAIMS, RESPONSE, SAMPLES))
def self_check(spark, sf):
    return rounded(G.self_check(samples(evidence(spark, sf))))


@query(
    "self_check_flags",
    on_evidence("""SELECT response_id, round(score,3) AS self_check_score, coalesce((SELECT string_agg('⚠ wobbly: '||ref||' ('||CAST(round(share*100) AS INTEGER)||'% 일관)','|' ORDER BY i) FROM
       (SELECT f.response_id, unnest(range(1,len(claims)+1)) AS i, claims[i].evidence_ref AS ref FROM smp f WHERE f.sample=0 AND f.response_id=scr.response_id) x JOIN shr USING (response_id, ref) WHERE share<0.5),'') AS flags FROM scr""", CLAIMS, RESPONSE, SAMPLES),
)
def self_check_flags(spark, sf):
    flagged = G.self_check_flags(samples(stored_evidence(spark, sf)))
    return flagged.select("response_id", "self_check_score", F.array_join("flags", "|").alias("flags"))


@query(
    "response_checks",
    """SELECT conv_id, turn, length("text") BETWEEN 1 AND 300 AS summary_ok, length("text") BETWEEN 1 AND 200 AS claim_text_ok, length("text")<=200 AS hint_ok, (turn%12)/10.0 BETWEEN 0 AND 1 AS confidence_ok,
       length("text") BETWEEN 1 AND 200 AND (turn%12)/10.0 BETWEEN 0 AND 1 AS valid FROM conversations""",
)
def response_checks(spark, sf):
    text = F.col("text")
    rows = fixtures.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.alias("summary"), text.alias("decision_hint"), ((F.col("turn") % 12) / 10.0).alias("confidence_raw"),
        F.array(F.struct(text.alias("text"), F.lit("recommendation.rank").alias("evidence_ref"))).alias("claims"),
    )
    return G.response_checks(rows).select(
        "conv_id", "turn", "summary_ok", "claim_text_ok", "hint_ok", "confidence_ok", "valid"
    )


CONFIDENCE = "cal AS (SELECT ((doc_id*37 % 101)/100.0)::DOUBLE AS p, quality AS y FROM labels)"


def calibration(spark, sf):
    return fixtures.table(spark, sf, "labels").select(
        ((F.col("doc_id") * 37 % 101) / 100.0).alias("confidence"), F.col("quality").alias("label")
    )


@query(
    "expected_calibration_error",
    f"""WITH {CONFIDENCE} SELECT round(sum(n*abs(a-c))/sum(n),6) AS ece FROM (SELECT least(floor(p*10),9) AS b, count(*) AS n, avg(y) AS a, avg(p) AS c FROM cal GROUP BY 1)""",
)
def expected_calibration_error(spark, sf):
    return rounded(G.expected_calibration_error(calibration(spark, sf)))


def _level(name: str, source: str, temps: str) -> str:
    p = f"least(greatest(1/(1+exp(-ln(least(greatest(p,1e-7),1-1e-7)/(1-least(greatest(p,1e-7),1-1e-7)))/t)),1e-7),1-1e-7)"
    return f"{name} AS (SELECT t FROM (SELECT t, avg(-(y*ln({p})+(1-y)*ln(1-{p}))) AS l FROM cal, ({temps}) GROUP BY 1) ORDER BY l, t LIMIT 1)"


@query(
    "fit_temperature",
    f"WITH {CONFIDENCE}, "
    + _level("l0", "", "SELECT 0.05*pow(200.0,i/40.0) AS t FROM range(0,41) r(i)")
    + ", " + _level("l1", "", "SELECT least(greatest((SELECT t FROM l0)*pow(200.0,(i-10)/400.0),0.05),10) AS t FROM range(0,21) r(i)")
    + ", " + _level("l2", "", "SELECT least(greatest((SELECT t FROM l1)*pow(200.0,(i-10)/4000.0),0.05),10) AS t FROM range(0,21) r(i)")
    + " SELECT (SELECT count(*) FROM cal) AS n, round(t,4) AS temperature FROM l2",
)
def fit_temperature(spark, sf):
    return G.fit_temperature(calibration(spark, sf)).withColumn("temperature", F.round("temperature", 4))


LEVELS = ", ".join(
    [
        CONFIDENCE,
        _level("l0", "", "SELECT 0.05*pow(200.0,i/40.0) AS t FROM range(0,41) r(i)"),
        _level("l1", "", "SELECT least(greatest((SELECT t FROM l0)*pow(200.0,(i-10)/400.0),0.05),10) AS t FROM range(0,21) r(i)"),
        _level("l2", "", "SELECT least(greatest((SELECT t FROM l1)*pow(200.0,(i-10)/4000.0),0.05),10) AS t FROM range(0,21) r(i)"),
    ]
)


@query(
    "calibrated_responses",
    on_evidence("SELECT user_id, item_id, confidence_raw, round(1/(1+exp(-ln(confidence_raw/(1-confidence_raw))/(SELECT t FROM l2))),4) AS confidence_calibrated FROM rp", CLAIMS, RESPONSE, LEVELS),
)
def calibrated_responses(spark, sf):
    responses = G.rule_response(evidence(spark, sf), question())
    rows = G.calibrated_responses(responses, G.fit_temperature(calibration(spark, sf)))
    return rows.select("user_id", "item_id", "confidence_raw", F.round("confidence_calibrated", 4).alias("confidence_calibrated"))


META = f"""meta AS (SELECT item_id, avg(price) AS price, any_value(c.category_code) AS category_code, any_value(b.brand) AS brand FROM train LEFT JOIN {mode_of('train','item_id','category_code')} c USING (item_id) LEFT JOIN {mode_of('train','item_id','brand')} b USING (item_id) GROUP BY 1)"""
HISTORY = """hx AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS r, (epoch_us((SELECT max(event_time) FROM train))-epoch_us(event_time))/86400e6 AS age FROM train),
 his AS (SELECT user_id, string_agg('['||event_type||'] '||coalesce(m.category_code,'unknown')||' / '||coalesce(m.brand,'unknown')||' / $'||CAST(round_even(hx.price,0) AS BIGINT)||' ('||CASE WHEN age<1 THEN CAST(floor(age*24) AS INTEGER)||'h ago' ELSE CAST(floor(age) AS INTEGER)||'d ago' END||')', chr(10) ORDER BY r DESC) AS history_text
   FROM hx LEFT JOIN meta m USING (item_id) WHERE r<=15 GROUP BY 1)"""


def histories(spark, sf):
    train = parts(spark, sf).train
    meta = windows.alias_items(train)
    return train, meta, P.history_text(train, meta)


@query("history_text", on_split("SELECT user_id, history_text FROM his", META, HISTORY))
def history_text(spark, sf):
    return histories(spark, sf)[2]


@query(
    "history_stats",
    on_split("SELECT round(avg(length(history_text)),6) AS mean_chars, round(avg(length(history_text)-length(replace(history_text,chr(10),'')))+1,6) AS mean_lines FROM his", META, HISTORY),
)
def history_stats(spark, sf):
    return rounded(P.history_stats(histories(spark, sf)[2]))


_HEAD, _REST = P.RANKING_PROMPT.replace("'", "''").split("{history}")
_MID, _TAIL = _REST.split("{candidates}")


@query(
    "prompt_table",
    on_preds(f"""SELECT user_id, '{_HEAD}'||coalesce(nullif(any_value(h.history_text),''),'(no history)')||'{_MID}'||string_agg('C'||CASE WHEN rank-1<10 THEN '0' ELSE '' END||(rank-1)||': '||coalesce(m.category_code,'unknown')||' / '||coalesce(m.brand,'unknown')||' / $'||CAST(round_even(m.price,0) AS BIGINT)||' (rank='||rank||', score='||printf('%.3f',p.score)||')', chr(10) ORDER BY rank)||'{_TAIL}' AS prompt,
      string_agg(CAST(p.item_id AS VARCHAR),'|' ORDER BY rank) AS candidates FROM preds p LEFT JOIN his h USING (user_id) LEFT JOIN meta m ON m.item_id=p.item_id WHERE model='freq' GROUP BY 1""", META, HISTORY),
)
def prompt_table(spark, sf):
    train, meta, history = histories(spark, sf)
    prompts = P.ranking_prompts(history, one_model(train, "freq"), meta)
    return prompts.withColumn("candidates", F.array_join(F.transform("candidates", lambda i: i.cast("string")), "|"))


@query("evidence_prompts")
def evidence_prompts(spark, sf):
    rows = stored_evidence(spark, sf)
    targets = rows.select("user_id", "item_id", question().alias("question_key"))
    return P.evidence_prompts(E.evidence_pack(rows), targets, windows.user_aliases(fixtures.activity_log(spark, sf)))


ANSWERS = """cnd AS (SELECT user_id, list(item_id ORDER BY rank) AS c FROM preds WHERE model='freq' AND rank<=30 GROUP BY 1),
 ans AS (SELECT user_id, c, CASE user_id%4 WHEN 0 THEN ['C05','c02','C99','C05','C00','C07','C01','C03','C04','C06','C08','C09','C10','C11'] WHEN 1 THEN ['C01','C00'] WHEN 2 THEN []::VARCHAR[] ELSE NULL END AS codes FROM cnd),
 psd AS (SELECT user_id, i, item FROM (SELECT user_id, i, c[CAST(substr(upper(codes[i]),2) AS INTEGER)+1] AS item FROM (SELECT *, unnest(range(1,len(codes)+1)) AS i FROM ans)) WHERE item IS NOT NULL),
 ded AS (SELECT user_id, item, min(i) AS i FROM psd GROUP BY 1,2), rk AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY i) AS r FROM ded),
 lst AS (SELECT user_id, string_agg(CAST(item AS VARCHAR),'|' ORDER BY r) AS items FROM rk WHERE r<=10 GROUP BY 1)"""


def answers(spark, sf):
    """Answers of four kinds by user: a noisy list, single quotes, an empty list, no list."""
    base = one_model(parts(spark, sf).train, "freq")
    rows = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    lists = base.filter("rank <= 30").groupBy("user_id").agg(F.transform(rows, lambda x: x["item_id"]).alias("candidates"))
    kind = F.col("user_id") % 4
    text = (
        F.when(kind == 0, 'Sure: ["C05", "c02", "C99", "C05", "C00", "C07", "C01", "C03", "C04", "C06", "C08", "C09", "C10", "C11"] [x]')
        .when(kind == 1, "['C01',\n 'C00']")
        .when(kind == 2, "[]")
        .otherwise("I cannot do that")
    )
    return base, P.parse_ranked_list(lists.withColumn("text", text))


@query("parse_ranked_list", on_preds("SELECT user_id, items FROM cnd LEFT JOIN lst USING (user_id)", ANSWERS))
def parse_ranked_list(spark, sf):
    return answers(spark, sf)[1].select(
        "user_id", F.array_join(F.transform("items", lambda i: i.cast("string")), "|").alias("items")
    )


@query(
    "apply_rerank_lists",
    on_preds("""SELECT user_id, item AS item_id, (11-r)::DOUBLE AS score, CAST(r AS INTEGER) AS rank FROM rk WHERE r<=10
       UNION ALL SELECT user_id, item_id, (11-rank)::DOUBLE, rank FROM preds WHERE model='freq' AND rank<=10 AND user_id NOT IN (SELECT user_id FROM lst)""", ANSWERS),
)
def apply_rerank_lists(spark, sf):
    base, parsed = answers(spark, sf)
    return P.apply_rerank_lists(parsed, base)


@query(
    "rerank_cost",
    """SELECT count(*) AS n_users, count(*) FILTER (WHERE turn%3=0) AS n_fallback, CAST(sum(length("text")) AS BIGINT) AS input_tokens, CAST(sum(turn*7) AS BIGINT) AS output_tokens,
       round(count(*) FILTER (WHERE turn%3=0)*1.0/count(*),6) AS fallback_share, round(sum(length("text"))/1000.0*0.0001+sum(turn*7)/1000.0*0.0001,6) AS cost FROM conversations""",
)
def rerank_cost(spark, sf):
    log = fixtures.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("user_id"), (F.col("turn") % 3 == 0).alias("fallback"),
        F.length("text").alias("input_tokens"), (F.col("turn") * 7).alias("output_tokens"),
    )
    return rounded(P.rerank_cost(log))


# A run over the users of ``answers``: users without a usable list fell back, tokens follow from the lists.
SUMMARY = [
    "lg AS (SELECT user_id, user_id NOT IN (SELECT user_id FROM lst) AS fallback, len(c) AS tin, user_id%5 AS tout FROM ans)",
    "rr AS (SELECT user_id, item AS item_id, r AS rank FROM rk WHERE r<=10 UNION ALL SELECT user_id, item_id, rank FROM preds WHERE model='freq' AND rank<=10 AND user_id NOT IN (SELECT user_id FROM lst))",
    "fr AS (SELECT 'rr' AS model, user_id, item_id, rank FROM rr UNION ALL SELECT model, user_id, item_id, rank FROM preds WHERE model='freq')",
    DCG.replace("FROM preds", "FROM fr"),
    "q AS (SELECT model, avg(ndcg) AS ndcg, avg(recall) AS recall FROM usr WHERE user_id IN (SELECT user_id FROM lg) GROUP BY 1)",
]


@query(
    "rerank_summary",
    on_preds(
        """SELECT n_users, n_fallback, input_tokens, output_tokens, round(n_fallback*1.0/n_users,6) AS fallback_share, round(input_tokens/1000.0*0.0001+output_tokens/1000.0*0.0001,6) AS cost,
  round(a.ndcg,6) AS ndcg, round(a.recall,6) AS recall, round(b.ndcg,6) AS base_ndcg, round(b.recall,6) AS base_recall, round(a.ndcg-b.ndcg,6) AS ndcg_delta, round(a.recall-b.recall,6) AS recall_delta
  FROM (SELECT count(*) AS n_users, count(*) FILTER (WHERE fallback) AS n_fallback, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens FROM lg),
   (SELECT * FROM q WHERE model='rr') a, (SELECT * FROM q WHERE model='freq') b""",
        ANSWERS,
        *SUMMARY,
    ),
)
def rerank_summary(spark, sf):
    base, parsed = answers(spark, sf)
    log = parsed.select(
        "user_id", F.col("items").isNull().alias("fallback"), F.size("candidates").alias("input_tokens"), (F.col("user_id") % 5).alias("output_tokens")
    )
    return rounded(P.rerank_summary(log, P.apply_rerank_lists(parsed, base), base, parts(spark, sf).gt))
