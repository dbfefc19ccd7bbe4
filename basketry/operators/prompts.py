"""Text in and out of a language model: histories, prompts and ranked answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import age_in_days
from basketry.operators.evidence import key_names
from basketry.operators.metrics import ndcg_at_k, recall_at_k
from basketry.operators.windows import last_n_events
from basketry.runtime import scalar

# Questions that can be asked about a recommendation.
QUESTIONS = {
    "why": "이 상품이 왜 저에게 추천되었나요?",
    "should_buy": "지금 살 만한가요?",
    "cheaper": "더 저렴한 대안이 있나요?",
    "fit_preference": "제 취향과 왜 맞나요?",
    "revisit": "왜 이 상품을 다시 보면 좋을까요?",
    "category_trend": "이 카테고리/브랜드가 왜 뜨고 있나요?",
    "promotion_candidate": "프로모션 후보로 적합한가요?",
    "discontinue_candidate": "단종 후보로 검토할 만한가요?",
}

RANKING_PROMPT = (
    "You order products for one shopper of an online shop.\n\n"
    "Recent events, oldest first:\n{history}\n\n"
    "Products to order, with their present rank and score:\n{candidates}\n\n"
    "Answer with a JSON array of the codes of the ten products most likely to be bought next week, best first, "
    'for example ["C03","C12"]. Write nothing else.'
)


def _dollars(price: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.bround(price, 0).cast("long").cast("string")), F.lit("$?"))


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def history_text(df: DataFrame, meta: DataFrame, n: int = 15, tie: str = "event_id") -> DataFrame:
    """The last ``n`` events of each user as lines, oldest first, with the item's category and brand and the event's price."""
    latest = scalar(df, F.max("event_time"))
    recent = last_n_events(df.select("user_id", "item_id", "event_type", "event_time", "price", tie), n, tie)
    age = age_in_days(F.col("event_time"), latest)
    when = F.when(age < 1, F.concat(F.floor(age * 24).cast("string"), F.lit("h ago"))).otherwise(
        F.concat(F.floor(age).cast("string"), F.lit("d ago"))
    )
    known = recent.join(meta.select("item_id", "category_code", "brand"), "item_id", "left")
    line = F.concat(
        F.lit("["), F.col("event_type"), F.lit("] "), _or_unknown(F.col("category_code")), F.lit(" / "),
        _or_unknown(F.col("brand")), F.lit(" / "), _dollars(F.col("price")), F.lit(" ("), when, F.lit(")"),
    )
    lines = F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("o"), F.col("_line").alias("t"))))
    return known.withColumn("_line", line).groupBy("user_id").agg(
        F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("history_text")
    )


def history_stats(history: DataFrame) -> DataFrame:
    """Mean number of characters and of lines."""
    return history.agg(
        F.avg(F.length("history_text")).alias("mean_chars"),
        (F.avg(F.length("history_text") - F.length(F.replace("history_text", F.lit("\n"), F.lit("")))) + 1).alias("mean_lines"),
    )


def _code(position: Column) -> Column:
    """C00, C01, ... by position in the list."""
    number = position.cast("string")
    return F.concat(F.lit("C"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))


def ranking_prompts(history: DataFrame, pred: DataFrame, meta: DataFrame, n: int = 50) -> DataFrame:
    """One ranking prompt per user: ``(user_id, prompt, candidates)``; the order of candidates gives their codes."""
    listed = pred.filter(F.col("rank") <= n).join(
        meta.select("item_id", "category_code", "brand", F.col("price").alias("_price")), "item_id", "left"
    )
    line = F.concat(
        _or_unknown(F.col("category_code")), F.lit(" / "), _or_unknown(F.col("brand")), F.lit(" / "), _dollars(F.col("_price")),
        F.lit(" (rank="), F.col("rank").cast("string"), F.lit(", score="), F.format_string("%.3f", F.col("score")), F.lit(")"),
    )
    rows = F.array_sort(F.collect_list(F.struct("rank", "item_id", line.alias("t"))))
    users = listed.groupBy("user_id").agg(rows.alias("_r")).join(history, "user_id", "left")
    lines = F.array_join(F.transform("_r", lambda x, i: F.concat(_code(i), F.lit(": "), x["t"])), "\n")
    head, rest = RANKING_PROMPT.split("{history}")
    middle, tail = rest.split("{candidates}")
    told = F.coalesce(F.nullif(F.col("history_text"), F.lit("")), F.lit("(no history)"))
    return users.select(
        "user_id",
        F.concat(F.lit(head), told, F.lit(middle), lines, F.lit(tail)).alias("prompt"),
        F.transform("_r", lambda x: x["item_id"]).alias("candidates"),
    )


def evidence_prompts(packs: DataFrame, targets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One message per row of ``targets`` (``user_id, item_id, question_key``): evidence, allowed keys and question."""
    document = packs.select("user_id", F.to_json(F.struct("user_id", "user_context", "recommendations")).alias("_pack"))
    # Documents are long, whatever Spark expects of them: they are never broadcast.
    joined = targets.join(document.hint("merge"), "user_id")
    if aliases is not None:
        joined = joined.join(aliases.select("user_id", "user_alias"), "user_id", "left")
    text = None
    for key, words in QUESTIONS.items():
        text = F.when(F.col("question_key") == key, words) if text is None else text.when(F.col("question_key") == key, words)
    alias = F.lit("")
    if aliases is not None:
        alias = F.coalesce(F.concat(F.lit("User, by name: "), F.col("user_alias"), F.lit("\n")), F.lit(""))
    allowed = "[\n" + ",\n".join(f'  "{k}"' for k in sorted(key_names())) + "\n]"
    prompt = F.concat(
        F.lit("User: "), F.col("user_id").cast("string"), F.lit("\n"), alias,
        F.lit("Item in question: "), F.col("item_id").cast("string"), F.lit("\nQuestion ("), F.col("question_key"),
        F.lit("): "), text.otherwise(F.col("question_key")),
        F.lit(f"\n\nBase every claim on one of these keys:\n{allowed}\n\nWhat is known:\n"), F.col("_pack"), F.lit("\n"),
    )
    return joined.select("user_id", "item_id", "question_key", prompt.alias("prompt"))


def parse_ranked_list(df: DataFrame, n: int = 10) -> DataFrame:
    """Items named by an answer: ``text`` with the first JSON list of codes, ``candidates`` in the order of the codes.

    Unknown and repeated codes are dropped, at most ``n`` items are kept; null if there is no usable list. A row holds
    its own candidates, so nothing is joined.
    """
    body = F.regexp_extract("text", r"(?s)\[(.*?)\]", 0)
    as_list = F.from_json(body, "array<string>", {"allowSingleQuotes": "false"})
    softened = F.from_json(F.replace(body, F.lit("'"), F.lit('"')), "array<string>", {"allowSingleQuotes": "false"})
    codes = F.transform("candidates", lambda _, i: _code(i))
    rows = df.withColumn("_codes", codes).withColumn("_named", F.coalesce(as_list, softened))
    item = F.transform(
        "_named", lambda c: F.get("candidates", F.array_position("_codes", F.upper(F.trim(c))).cast("int") - 1)
    )
    items = F.slice(F.array_distinct(F.array_compact(item)), 1, n)
    return rows.withColumn("items", F.when(F.size(items) > 0, items)).drop("_codes", "_named")


def apply_rerank_lists(lists: DataFrame, base: DataFrame, k: int = 10) -> DataFrame:
    """Ranked rows with score k+1-rank from each user's list; a user without usable list keeps the base model's first ``k``."""
    usable = lists.filter(F.col("items").isNotNull() & (F.size("items") > 0))
    own = usable.select("user_id", F.posexplode("items").alias("_p", "item_id")).select(
        "user_id", "item_id", (F.col("_p") + 1).alias("rank")
    )
    others = lists.select("user_id").join(usable.select("user_id"), "user_id", "left_anti")
    fallback = base.filter(F.col("rank") <= k).join(others, "user_id", "left_semi").select("user_id", "item_id", "rank")
    return own.unionByName(fallback).select(
        "user_id", "item_id", (k + 1 - F.col("rank")).cast("double").alias("score"), "rank"
    )


def rerank_cost(log: DataFrame, per_thousand_in: float = 0.0001, per_thousand_out: float = 0.0001) -> DataFrame:
    """Users, fallbacks, tokens and cost of a reranking run (``user_id, fallback, input_tokens, output_tokens``)."""
    totals = log.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if("fallback").alias("n_fallback"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    cost = F.col("input_tokens") / 1000 * per_thousand_in + F.col("output_tokens") / 1000 * per_thousand_out
    share = F.col("n_fallback") / F.nullif(F.col("n_users"), F.lit(0))
    return totals.select("*", share.alias("fallback_share"), cost.alias("cost"))


def rerank_summary(log: DataFrame, reranked: DataFrame, base: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """``rerank_cost`` of a run with the NDCG and recall of its lists, those of the base lists of the same users, and the differences. One row."""
    truth = gt.join(log.select("user_id").distinct(), "user_id", "left_semi")
    measures = {
        f"{side}{name}": measure(lists, truth, k).select(name).scalar()
        for side, lists in (("", reranked), ("base_", base))
        for name, measure in (("ndcg", ndcg_at_k), ("recall", recall_at_k))
    }
    differences = {f"{name}_delta": F.col(name) - F.col(f"base_{name}") for name in ("ndcg", "recall")}
    return rerank_cost(log).withColumns(measures).withColumns(differences)
