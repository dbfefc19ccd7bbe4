"""Checks of explanations against evidence, consistency over samples, and calibration of confidence."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import apply_temperature
from basketry.functions.text import looks_negated
from basketry.operators.evidence import ITEM_FIELDS, quoted, support_columns
from basketry.runtime import scalar

# Limits of a response.
TEXT_LIMIT, SUMMARY_LIMIT, HINT_LIMIT, MAX_CLAIMS = 200, 300, 200, 6

# Texts of claims by evidence key. Braces are filled from the evidence row.
CLAIM_TEXTS = {
    "signals.item_recent14_pop_log1p": "최근 14일 인기가 높습니다",
    "signals.model_hit_count": "{hits}개 모델({models})이 함께 추천했습니다",
    "signals.carted_before": "이전에 장바구니에 담은 적이 있습니다",
    "signals.seen_before": "이전에 본 적이 있는 상품입니다",
    "signals.price_in_user_band": "평소 보던 가격대 안에 있습니다",
    "signals.brand_affinity": "평소 관심 브랜드({brand})와 맞습니다",
    "user_context.carted_brands": "평소 담아두던 브랜드({brand})입니다",
    "signals.category_l2_affinity": "자주 보던 카테고리({category})와 맞습니다",
    "recommendation.rank": "앙상블 {rank}위로 추천되었습니다",
    "signals.cart_without_purchase": "장바구니에 담아두셨던 상품입니다",
    "signals.last_interaction_days": "최근 관심 가지셨던 상품입니다",
    "signals.last_event_type": "마지막 상호작용은 {event}였습니다",
    "signals.revisit_event_count": "여러 번 확인하신 상품입니다",
    "signals.revisit_score": "과거 행동 기준 재방문 점수가 있습니다",
}
REVISIT_ANYWAY = "재방문 이력 기반 후보입니다"

# Summaries by question; two texts are for at least two claims and for fewer.
SUMMARY_TEXTS = {
    "why": ["{brand}의 {category} 상품이며, {n}가지 근거가 일치합니다."],
    "should_buy": ["근거가 충분해 담아두기를 권합니다.", "근거가 약하니 조금 더 살펴보세요."],
    "cheaper": ["현재 가격은 {price}이며, 더 저렴한 대안 비교에는 추가 정보가 필요합니다."],
    "fit_preference": ["취향 신호가 일치합니다.", "취향 일치 신호는 약합니다."],
    "revisit": ["다시 볼 만한 과거 관심 신호가 있습니다.", "재방문 근거는 제한적입니다."],
    "category_trend": ["{category} 카테고리에서 최근 조회 추세와 전환 근거를 확인했습니다."],
    "promotion_candidate": ["조회·전환·취향 신호가 있어 프로모션 후보로 적합합니다.", "프로모션 후보로는 근거가 약합니다."],
    "discontinue_candidate": ["단종 후보로는 부적합합니다.", "추천 합의가 약해 단종 검토 여지가 있습니다."],
}
OTHER_SUMMARY = "{brand} — {n}가지 근거 확인."
NO_BRAND, NO_CATEGORY = "이 상품", "이 카테고리"

# Decision hints by question, for a high and for a low confidence, and the limits between them.
HINT_TEXTS = {
    "should_buy": ["담아두고 가격 변동 확인", "추가 조사 권장"],
    "revisit": ["장바구니 상태와 가격을 다시 확인", "비슷한 상품과 비교"],
    "promotion_candidate": ["소규모 A/B 실험 권장", "보류"],
}
OTHER_HINTS = ["현재 근거로 충분", "추가 정보 필요"]
SURE, SURE_OTHERWISE = 0.65, 0.7


def hard_gate(responses: DataFrame, rows: DataFrame) -> DataFrame:
    """Failures of each response against the evidence it was given for, and the badge.

    ``responses``: ``response_id, pack_user_id, user_id, item_id, summary, claims<text, evidence_ref>``; ``rows``: evidence
    rows. A response meets one evidence row, and all of its claims are checked inside that row. Evidence is wide, and Spark takes its
    texts and lists for much smaller than they are, so it must not be broadcast; maps are made of it after the join.
    """
    nested = F.struct(*ITEM_FIELDS, "signals", "user_context").alias("_evidence")
    known = rows.select(F.col("user_id").alias("pack_user_id"), "item_id", nested).hint("merge")
    maps = support_columns(rows, "_evidence.")
    names = {"supported": "_supported", "is_true": "_true", "shown": "_shown"}
    joined = responses.join(known, ["pack_user_id", "item_id"], "left").withColumns(
        {names[n]: F.when(F.col("_evidence").isNotNull(), column) for n, column in maps.items()}
    ).drop("_evidence")

    def text(column: str) -> Column:
        return F.col(column).cast("string")

    mismatch = F.when(
        ~F.col("user_id").eqNullSafe(F.col("pack_user_id")),
        F.concat(F.lit("user_id mismatch: "), text("user_id"), F.lit(" != "), text("pack_user_id")),
    )
    unknown = F.when(
        F.col("_supported").isNull(), F.concat(F.lit("item_id not in recommendations: "), text("item_id"))
    )

    def check(claim: Column, i: Column) -> Column:
        key = claim["evidence_ref"]
        where = F.concat(F.lit("claim["), i.cast("string"), F.lit("] "))
        value = F.concat(F.lit(": value="), F.col("_shown")[key])
        return (
            F.when(
                ~F.coalesce(F.map_contains_key("_supported", key), F.lit(False)),
                F.concat(where, F.lit("evidence_ref not in whitelist: "), key),
            )
            .when(~F.col("_supported")[key], F.concat(where, F.lit("evidence is empty/false at "), key, value))
            .when(
                F.col("_true")[key] & looks_negated(claim["text"]),
                F.concat(where, F.lit("text contradicts "), key, value, F.lit(", text="), quoted(claim["text"])),
            )
        )

    claims = F.when(F.col("_supported").isNotNull(), F.transform("claims", check)).otherwise(F.array().cast("array<string>"))
    failures = F.array_compact(F.concat(F.array(mismatch, unknown), claims))
    checked = joined.withColumn("failures", failures).drop("_supported", "_true", "_shown")
    passed = F.size("failures") == 0
    rejected = F.concat(
        F.lit("[검증 실패] "), F.col("summary"), F.lit("\n오류: "), F.array_join(F.slice("failures", 1, 2), "; ")
    )
    return checked.withColumns(
        {
            "badge": F.when(passed, "verified").otherwise("rejected"),
            "response_text": F.when(passed, F.col("summary")).otherwise(rejected),
        }
    )


def consistency(samples: DataFrame) -> DataFrame:
    """Per response: number of samples, and for each key the first sample cites the share of the others citing it too.

    ``samples``: ``response_id, sample`` (numbered from 0, the first) and ``claims``. One pass over the samples; the
    shares of a response are a small map, as a response has few keys.
    """
    cited = (
        samples.select("response_id", "sample", F.explode_outer("claims.evidence_ref").alias("ref")).distinct()
        .groupBy("response_id", "ref")
        .agg(
            F.bool_or(F.col("sample") == 0).alias("_first"),
            F.count_if(F.col("sample") > 0).alias("_n"),
            F.max("sample").alias("_last"),
        )
    )
    wanted = F.when(F.col("_first") & F.col("ref").isNotNull(), F.struct("ref", "_n"))
    per_response = cited.groupBy("response_id").agg(
        (F.max("_last") + 1).alias("n_samples"), F.sort_array(F.collect_list(wanted)).alias("_refs")
    )
    others = F.col("n_samples") - 1
    shares = F.when(others > 0, F.map_from_entries(F.transform("_refs", lambda r: F.struct(r["ref"], r["_n"] / others))))
    return per_response.select("response_id", "n_samples", shares.alias("shares"))


def self_check(samples: DataFrame) -> DataFrame:
    """Consistency of a response: mean of these shares; 1 for a single sample, 0 if the first cites nothing."""
    return _scored(consistency(samples)).select("response_id", "n_samples", "score")


def _scored(checked: DataFrame) -> DataFrame:
    total = F.aggregate(F.map_values("shares"), F.lit(0.0), lambda a, x: a + x)
    mean = F.coalesce(total / F.nullif(F.size("shares"), F.lit(0)), F.lit(0.0))
    return checked.withColumn("score", F.when(F.col("n_samples") == 1, F.lit(1.0)).otherwise(mean))


def self_check_flags(samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """First samples with their consistency (3 places) and a flag for each claim key below the threshold.

    Flags follow the order of the claims.
    """
    checked = _scored(consistency(samples)).select(
        "response_id", F.bround("score", 3).alias("self_check_score"), F.col("shares").alias("_shares")
    )

    def flag(claim: Column) -> Column:
        share = F.coalesce(F.try_element_at("_shares", claim["evidence_ref"]), F.lit(1.0))
        percent = F.bround(share * 100).cast("int").cast("string")
        text = F.concat(F.lit("⚠ wobbly: "), claim["evidence_ref"], F.lit(" ("), percent, F.lit("% 일관)"))
        return F.when(share < threshold, text)

    first = samples.filter(F.col("sample") == 0).join(checked, "response_id")
    before = F.col("flags") if "flags" in samples.columns else F.array().cast("array<string>")
    return first.withColumn("flags", F.concat(before, F.array_compact(F.transform("claims", flag)))).drop("_shares")


def _fill(template: str, values: dict[str, Column]) -> Column:
    """A text with named places as one concatenation of columns."""
    pieces = [
        values[field] if field is not None else F.lit(text)
        for before, name, _, _ in Formatter().parse(template)
        for text, field in ((before, None), ("", name))
        if field is not None or text
    ]
    return F.concat(*pieces)


def _claim(condition: Column, key: str, values: dict[str, Column], text: str | None = None) -> Column:
    """Claim with its key if the condition holds, else null."""
    return F.when(
        condition, F.struct(_fill(text or CLAIM_TEXTS[key], values).alias("text"), F.lit(key).alias("evidence_ref"))
    )


def rule_claims(rows: DataFrame, question: str | Column = "why", n: int = 4) -> Column:
    """Claims that the signals of an evidence row justify, in fixed order, at most ``n``; never empty."""
    s = {c: F.col(f"signals.{c}") for c in rows.schema["signals"].dataType.names}
    values = {
        "hits": s["model_hit_count"].cast("string"),
        "models": F.array_join(F.slice(s["models_recommending"], 1, 2), "·"),
        "brand": F.col("brand"),
        "category": F.coalesce("category_l2", "category_code"),
        "rank": F.col("rank").cast("string"),
        "event": s["last_event_type"],
    }
    always = F.lit(True)
    recent = F.coalesce(s["last_interaction_days"] <= 7, F.lit(False))

    def first_or(conditions: dict[str, Column], text: str | None = None) -> Column:
        claims = F.array_compact(F.array(*[_claim(c, key, values) for key, c in conditions.items()]))
        return F.when(F.size(claims) > 0, claims).otherwise(F.array(_claim(always, "recommendation.rank", values, text)))

    about = first_or(
        {
            "signals.item_recent14_pop_log1p": s["item_recent14_pop_log1p"] > 3.0,
            "signals.model_hit_count": s["model_hit_count"] >= 2,
            "signals.carted_before": s["carted_before"],
            "signals.seen_before": ~s["carted_before"] & s["seen_before"],
            "signals.price_in_user_band": s["price_in_user_band"],
            "signals.brand_affinity": s["brand_affinity"],
            "user_context.carted_brands": ~s["brand_affinity"] & F.array_contains("user_context.carted_brands", F.col("brand")),
            "signals.category_l2_affinity": s["category_l2_affinity"],
        }
    )
    again = first_or(
        {
            "signals.cart_without_purchase": s["cart_without_purchase"],
            "signals.last_interaction_days": recent,
            "signals.last_event_type": ~recent & s["last_event_type"].isNotNull(),
            "signals.revisit_event_count": s["revisit_event_count"] >= 3,
            "signals.revisit_score": s["revisit_score"].isNotNull(),
        },
        REVISIT_ANYWAY,
    )
    asked = F.lit(question) if isinstance(question, str) else question
    return F.slice(F.when(asked == "revisit", again).otherwise(about), 1, n)


def _by_question(question: Column, choices: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for key, choice in choices.items():
        out = F.when(question == key, choice) if out is None else out.when(question == key, choice)
    return out.otherwise(otherwise)


def _summary(question: Column, n: Column) -> Column:
    values = {
        "brand": F.coalesce(F.nullif(F.col("brand"), F.lit("")), F.lit(NO_BRAND)),
        "category": F.coalesce(F.nullif(F.col("category_code"), F.lit("")), F.lit(NO_CATEGORY)),
        "price": F.coalesce(F.col("price").cast("string"), F.lit("None")),
        "n": n.cast("string"),
    }

    def text(versions: list[str]) -> Column:
        strong = _fill(versions[0], values)
        return strong if len(versions) == 1 else F.when(n >= 2, strong).otherwise(_fill(versions[1], values))

    return _by_question(question, {k: text(v) for k, v in SUMMARY_TEXTS.items()}, _fill(OTHER_SUMMARY, values))


def _hint(question: Column, confidence: Column) -> Column:
    def pick(texts: list[str], limit: float) -> Column:
        return F.when(confidence > limit, texts[0]).otherwise(texts[1])

    return _by_question(question, {k: pick(v, SURE) for k, v in HINT_TEXTS.items()}, pick(OTHER_HINTS, SURE_OTHERWISE))


def rule_response(rows: DataFrame, question: str | Column = "why") -> DataFrame:
    """A response per evidence row: summary, claims, confidence by number of claims, and a hint."""
    asked = F.lit(question) if isinstance(question, str) else question
    answered = rows.withColumn("question_key", asked).withColumn("claims", rule_claims(rows, F.col("question_key")))
    n = F.size("claims")
    base = F.least(F.lit(0.95), 0.35 + 0.13 * n)
    carted = (F.col("question_key") == "revisit") & F.col("signals.cart_without_purchase")
    confidence = F.round(F.when(carted, F.least(F.lit(0.95), base + 0.12)).otherwise(base), 3)
    return answered.select(
        "user_id", "item_id", "rank", "question_key",
        _summary(F.col("question_key"), n).alias("summary"),
        "claims",
        _hint(F.col("question_key"), confidence).alias("decision_hint"),
        confidence.alias("confidence_raw"),
    )


def response_checks(df: DataFrame) -> DataFrame:
    """Length and range limits of a response, one flag per rule and one for all."""
    texts = F.forall("claims", lambda c: F.coalesce(F.length(c["text"]).between(1, TEXT_LIMIT), F.lit(False)))
    keys = F.forall("claims", lambda c: F.coalesce(F.length(c["evidence_ref"]) >= 1, F.lit(False)))
    rules = {
        "summary_ok": F.length("summary").between(1, SUMMARY_LIMIT),
        "claims_ok": F.size("claims").between(1, MAX_CLAIMS),
        "claim_text_ok": texts,
        "claim_key_ok": keys,
        "hint_ok": F.length("decision_hint") <= HINT_LIMIT,
        "confidence_ok": F.col("confidence_raw").between(0.0, 1.0),
    }
    flags = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    every = F.lit(True)
    for name in flags:
        every = every & F.col(name)
    return df.withColumns(flags).withColumn("valid", every)


def expected_calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean distance between confidence and accuracy over equal-width bins, weighted by their size; 0 without rows."""
    slot = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    rows = df.filter((F.col("confidence") >= 0) & (F.col("confidence") <= 1))
    binned = rows.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("accuracy"), F.avg("confidence").alias("mean_confidence")
    )
    # At most ``bins`` rows are left; the size of the whole table includes rows outside the range.
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return binned.agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("_e")).select(
        F.coalesce(F.col("_e") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("ece")
    )


LOW, HIGH = 0.05, 10.0


def _best_temperature(counted: DataFrame, temperatures: list[Column]) -> Column:
    """The temperature of a list with the lowest log loss. Losses are combined on the map side, one row per temperature."""
    tried = counted.select("confidence", "label", "_n", F.explode(F.array(*temperatures)).alias("t"))
    p = F.least(F.greatest(apply_temperature(F.col("confidence"), F.col("t")), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    return tried.groupBy("t").agg((F.sum(F.col("_n") * loss) / F.sum("_n")).alias("loss")).agg(
        F.min(F.struct("loss", "t"))["t"].alias("t")
    ).scalar()


def fit_temperature(df: DataFrame, steps: int = 40) -> DataFrame:
    """Temperature between 0.05 and 10 with the lowest log loss; 1 for fewer than three rows.

    The loss has a single minimum, so a coarse geometric grid is refined twice around its best point. Equal
    (confidence, label) rows are counted first, and each level is one aggregate.
    """
    counted = df.groupBy("confidence", F.col("label").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    ratio = HIGH / LOW
    best = _best_temperature(counted, [F.lit(LOW * ratio ** (i / steps)) for i in range(steps + 1)])
    for level in (1, 2):
        factor = ratio ** (1.0 / (steps * 10**level))
        around = [F.least(F.greatest(F.col("_t") * factor**j, F.lit(LOW)), F.lit(HIGH)) for j in range(-10, 11)]
        best = _best_temperature(counted.withColumn("_t", best), around)
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return counted.agg(total.alias("n")).select(
        "n", F.when(F.col("n") < 3, F.lit(1.0)).otherwise(best).alias("temperature")
    )


def calibrated_responses(responses: DataFrame, fitted: DataFrame) -> DataFrame:
    """Responses with ``confidence_calibrated``, from ``confidence_raw`` and the one row of ``fit_temperature``."""
    temperature = scalar(fitted, F.max("temperature"))
    return responses.withColumn("confidence_calibrated", apply_temperature(F.col("confidence_raw"), temperature))
