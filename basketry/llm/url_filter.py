"""URL filters: rules for hosts and paths, and for all other URLs the ratio of two character language models.

The URLs that the rules block and those that they allow train one Markov model each, over all pages. Models are of variable
order: the chance of a character after the last ``ORDER`` ones is mixed with that after the last ``ORDER - 1``, and so on, by
Witten-Bell smoothing, so that unseen contexts fall back to shorter ones. A URL's score is the difference of the models'
log-likelihoods of host and path, divided by their length. The score from which a URL is allowed is calibrated out of fold:
models of either half of the training URLs score the other half, and the cut is where the rates of wrongly allowed and
wrongly blocked URLs add up to the least.

Characters count as one of ``SYMBOLS``: letters regardless of case, digits, ``-``, ``.``, ``/`` and one for all others. So a
model has at most SYMBOLS ** (ORDER + 1) counts however many URLs there are, and its table of log ratios may be sent to every task.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and scores 0; among rules of equal
length the first in text order wins; rows are judged one by one; if the rules block or allow no URL at all, the method allows
everything; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import slices

ORDER = 3
# 0 begins and ends a URL, 1-26 letters, 27-36 digits, 37 '-', 38 '.', 39 '/', 40 all others.
SYMBOLS = 41
SYMBOL_OF = np.full(256, 40, np.int64)
SYMBOL_OF[65:91] = SYMBOL_OF[97:123] = np.arange(1, 27)
SYMBOL_OF[48:58] = np.arange(27, 37)
SYMBOL_OF[list(b"-./")] = [37, 38, 39]
CELLS = SYMBOLS ** (ORDER + 1)
# Steps of scores in which the cut is looked for.
STEP = 0.002
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host and path in one) that fits, or null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of every character with the ORDER characters before it; an end mark follows each text."""
    texts = len(offsets) - 1
    gap = ORDER + 1
    sizes = np.diff(offsets)
    symbols = np.zeros(len(data) + gap * texts + ORDER, np.int64)
    owner = np.repeat(np.arange(texts), sizes)
    symbols[ORDER + np.arange(len(data)) + gap * owner] = SYMBOL_OF[data]
    code = np.zeros(len(symbols) - ORDER, np.int64)
    for n in range(ORDER + 1):
        code = code * SYMBOLS + symbols[n : len(symbols) - ORDER + n]
    # The characters and the first mark behind them; the other marks are the next text's empty context.
    of = np.repeat(np.arange(texts), sizes + gap)
    inside = np.arange(len(of)) - np.repeat(offsets[:-1] + gap * np.arange(texts), sizes + gap) <= np.repeat(sizes, sizes + gap)
    inside &= np.repeat(sizes > 0, sizes + gap)
    return of[inside], code[: len(of)][inside]


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def cell_counts(urls: DataFrame) -> DataFrame:
    """(part, cell, total): ``urls`` has text and a part 0 to 3, twice the label plus the half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _ids(batch, "part")
            for first, end, data, offsets in slices(batch):
                text, cell = _codes(data, offsets)
                key, total = np.unique(parts[first:end][text] * CELLS + cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key // CELLS).astype(np.int32)), pa.array((key % CELLS).astype(np.int32)), pa.array(total)], ["part", "cell", "total"])

    return urls.select("text", "part").mapInArrow(run, "part int, cell int, total long").groupBy("part", "cell").agg(F.sum("total").alias("total"))


def log_chances(counts: np.ndarray) -> np.ndarray:
    """Log-probability of each cell's last character after the others."""
    chances = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        table = counts.reshape(-1, SYMBOLS ** (order + 1)).sum(axis=0).reshape(-1, SYMBOLS)
        seen, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(chances.reshape(-1, SYMBOLS), (max(1, len(table) // max(1, chances.size // SYMBOLS)), 1))
        chances = np.where(seen > 0, (table + kinds * shorter) / np.maximum(seen + kinds, 1), shorter)
    return np.log(chances).ravel()


def _scores(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    text, cell = _codes(data, offsets)
    sums = np.bincount(text, ratio[cell], minlength=texts) if len(text) else np.zeros(texts)
    return sums / np.maximum(1, np.bincount(text, minlength=texts))


@dataclass
class UrlModel:
    ratio: np.ndarray | None
    cut: float


def fit(urls: DataFrame) -> UrlModel:
    """A model from (text, allowed boolean). Runs jobs; the driver holds counts by cell and by step of the score."""
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    urls = urls.select("text", (2 * F.col("allowed").cast("int") + half).alias("part"))
    rows = cell_counts(urls).toPandas()
    counts = np.zeros((4, CELLS))
    counts[rows["part"], rows["cell"]] = rows["total"]
    if not counts[:2].any() or not counts[2:].any():
        return UrlModel(None, 0.0)

    def ratio(parts_rejected: list[int], parts_accepted: list[int]) -> np.ndarray:
        difference = log_chances(counts[parts_accepted].sum(axis=0)) - log_chances(counts[parts_rejected].sum(axis=0))
        return difference.astype(np.float32)

    other_half = [ratio([1], [3]), ratio([0], [2])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _ids(batch, "part")
            for first, end, data, offsets in slices(batch):
                mine = parts[first:end]
                score = np.where(mine % 2 == 0, _scores(data, offsets, other_half[0]), _scores(data, offsets, other_half[1]))
                step = np.floor(score / STEP).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array((mine // 2).astype(np.int32)), pa.array(step)], ["allowed", "step"])

    histogram = urls.mapInArrow(run, "allowed int, step int").groupBy("allowed", "step").count().toPandas()
    steps = np.arange(histogram["step"].min(), histogram["step"].max() + 2)
    at = histogram["step"].to_numpy() - steps[0]
    totals = np.zeros((2, len(steps)))
    np.add.at(totals, (histogram["allowed"].to_numpy(), at), histogram["count"].to_numpy())
    shares = totals / totals.sum(axis=1, keepdims=True)
    # From step i on URLs are allowed: rejected ones there, and accepted ones below, are wrong.
    wrong = shares[0].sum() - (np.cumsum(shares[0]) - shares[0]) + np.cumsum(shares[1]) - shares[1]
    ties = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return UrlModel(ratio([0, 1], [2, 3]), float(steps[ties[len(ties) // 2]] * STEP))


def judged(pages: DataFrame, rules: dict[str, str], id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; verdict is the rule's, else the method's."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowing = [r for r, v in rules.items() if v == "allow"]
    text = F.concat("host", "path")
    model = fit(rows.filter("rule is not null").select(text.alias("text"), F.col("rule").isin(allowing).alias("allowed")))
    ratio = model.ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                score = np.zeros(end - first) if ratio is None else _scores(data, offsets, ratio)
                yield pa.RecordBatch.from_arrays([batch.column(n).slice(first, end - first) for n in range(4)] + [pa.array(score)], ["id", "host", "path", "rule", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.select("id", "host", "path", "rule", text.alias("text")).mapInArrow(run, f"id {kind}, host string, path string, rule string, score double")
    by_rule = F.when(F.col("rule").isNull(), F.lit(None))
    for rule, verdict in rules.items():
        by_rule = by_rule.when(F.col("rule") == rule, F.lit(verdict))
    by_method = F.when(F.lit(ratio is None) | (F.col("score") >= model.cut), "allow").otherwise("block")
    return scored.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce(by_rule, by_method).alias("verdict"), "score")
