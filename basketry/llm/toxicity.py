"""Toxicity by weak supervision: voters, a generative model of their votes, and a linear classifier on its posteriors.

Voters are found in the labelled rows given for fitting: lexicon voters are whole words, pattern voters are beginnings of words
(3 to 7 bytes), each chosen because it stands much oftener in documents that are marked. A voter votes for "toxic" when
its word or beginning occurs in a document and abstains otherwise; one more voter votes for "clean" when all abstain.

The label model takes the true label as hidden. It estimates by expectation and maximisation how often each voter fires for
either label, and from the posteriors how the voters' votes correlate beyond the label; a voter's evidence is divided by the
number of voters that say the same, so that a word, its beginnings and its copies do not count many times. The given label is
one more voter, right more or less often. The classifier is a logistic regression with an L1 penalty on the presence of words and beginnings, fitted to the
posteriors; every whole text is then scored by it.

Fitting uses at most ``sample`` labelled rows, those with the smallest hashes, and at most ``most_features`` features and
``most_voters`` voters; these bounds hold on the driver too. Labels, language, source and doc_id are no inputs of a score.

Defined results: null and empty texts have the score of a text without features; rows with equal texts have equal scores;
without labelled rows of both kinds the score is 0 everywhere, or 1 if all are marked; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import NO_LETTER, Hasher, slices, stored, word_bounds

BEGINNINGS = (3, 4, 5, 6, 7)
LEAST_DOCS = 3
# At least this share of the documents with a voter's word must be marked, by the lower end of Wilson's interval (80 %),
LEAST_SHARE = 0.65
# and their number must exceed chance by so many standard deviations.
LEAST_SURPRISE = 5.0
# Voters that correlate less than this within the labels count as independent.
DEPENDENT = 0.5
PENALTY = 0.1


def occurrences(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, text, start and end of each word, then of each beginning by length; a word and a beginning never share a hash."""
    hasher.prepare(data)
    starts, ends, owner = word_bounds(data, offsets, NO_LETTER)
    yield hasher.spans(starts, ends), owner, starts, ends
    for length in BEGINNINGS:
        longer = ends - starts > length
        begin = starts[longer]
        yield ~hasher.spans(begin, begin + length), owner[longer], begin, begin + length


def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(batch.schema.get_field_index("text")))], ["text"])


def feature_counts(train: DataFrame) -> DataFrame:
    """(hash, name, marked, unmarked): documents with each word and beginning, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in slices(lowered(batch)):
                mine = labels[first:end]
                for hashes, owner, starts, ends in occurrences(data, offsets, hasher):
                    # One of each feature in each document.
                    order = np.lexsort((owner, hashes))
                    h, o = hashes[order], owner[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                    h, o, order = h[new], o[new], order[new]
                    units, at = np.unique(h, return_index=True)
                    marked = np.add.reduceat(mine[o], at) if len(at) else np.zeros(0, np.int64)
                    every = np.diff(np.append(at, len(h)))
                    names = [data[starts[i] : ends[i]].tobytes() for i in order[at]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(units.astype(np.int64)), pa.array(names, pa.binary()), pa.array(marked.astype(np.int64)), pa.array((every - marked).astype(np.int64))],
                        ["hash", "name", "marked", "unmarked"],
                    )

    counted = train.select("text", "toxic").mapInArrow(run, "hash long, name binary, marked long, unmarked long")
    return counted.groupBy("hash").agg(F.first("name").alias("name"), F.sum("marked").alias("marked"), F.sum("unmarked").alias("unmarked"))


def documents_features(df: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(toxic, features array<int>): which of the sorted ``hashes`` each document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, end, data, offsets in slices(lowered(batch)):
                owner, feature = present(data, offsets, hashes, hasher)
                bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=end - first))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, end - first), lists], ["toxic", "features"])

    return df.select("text", "toxic").mapInArrow(run, "toxic int, features array<int>")


def present(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each feature that occurs in a text, once each."""
    size = len(hashes)
    found = [np.zeros(0, np.int64)]
    for value, owner, *_ in occurrences(data, offsets, hasher) if size else ():
        at = np.minimum(np.searchsorted(hashes, value), size - 1)
        hit = hashes[at] == value
        found.append(owner[hit] * size + at[hit])
    both = np.unique(np.concatenate(found))
    return both // max(1, size), both % max(1, size)


@dataclass
class LabelModel:
    """How often each voter fires for either label, and by how much its evidence counts."""

    prior: float
    fires: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray, further: np.ndarray | float = 0.0) -> np.ndarray:
        evidence = np.log(self.fires[1] / self.fires[0]) * self.weight
        logit = np.log(self.prior / (1 - self.prior)) + votes @ evidence + further
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> tuple[LabelModel, np.ndarray]:
    """The model of a matrix of votes (documents by voters, 1 where a voter does not abstain) and each document's posterior.

    The last column of the model is the voter for "clean". The labels vote too, with the accuracy they turn out to have.
    """
    votes = np.column_stack([votes, ~votes.any(axis=1)]).astype(np.float32)
    posterior = np.where(labels > 0, 0.95, 0.05)
    model = None
    for _ in range(rounds):
        masses = np.stack([1 - posterior, posterior])
        totals = masses.sum(axis=1)
        fires = np.clip((masses @ votes + 0.05) / (totals[:, None] + 1), 1e-5, 0.999)
        # Correlation within the labels: one where two voters always fire together.
        covariance = sum((votes * m[:, None]).T @ votes - t * np.outer(f, f) for m, t, f in zip(masses, totals, fires))
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        correlation = np.clip(covariance / np.outer(spread, spread), 0, 1)
        correlation[correlation < DEPENDENT] = 0
        np.fill_diagonal(correlation, 1)
        model = LabelModel(float(np.clip(totals[1] / totals.sum(), 1e-4, 1 - 1e-4)), fires, 1 / correlation.sum(axis=1))
        agrees = np.where(labels > 0, posterior, 1 - posterior).mean()
        accuracy = float(np.clip(agrees, 0.7, 0.97))
        posterior = model.posterior(votes, np.where(labels > 0, 1, -1) * np.log(accuracy / (1 - accuracy)))
    return model, posterior


def fit_linear(features: list[np.ndarray], size: int, target: np.ndarray, penalty: float = PENALTY, sweeps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-penalised logistic regression on the presence of features, by coordinate descent."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    columns = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(columns, kind="stable")
    rows = rows[order]
    bounds = np.searchsorted(columns[order], np.arange(size + 1))
    weights, bias, margin = np.zeros(size), 0.0, np.zeros(len(target))
    for _ in range(sweeps):
        largest = 0.0
        for j in range(-1, size):
            mine = rows[bounds[j] : bounds[j + 1]] if j >= 0 else slice(None)
            p = 1 / (1 + np.exp(-margin[mine]))
            slope, bend = float((p - target[mine]).sum()), float((p * (1 - p)).sum()) + 1e-3
            old = weights[j] if j >= 0 else bias
            new = old - slope / bend
            if j >= 0:
                new = np.sign(new) * max(0.0, abs(new) - penalty / bend)
            step = float(np.clip(new - old, -1, 1))
            if step:
                margin[mine] += step
                largest = max(largest, abs(step))
                if j >= 0:
                    weights[j] += step
                else:
                    bias += step
        if largest < 0.01:
            break
    return weights, bias


@dataclass
class ToxicityModel:
    hashes: np.ndarray
    names: list[str]
    weights: np.ndarray
    bias: float
    voters: list[str]
    label_model: LabelModel | None


def fit(documents: DataFrame, labels: DataFrame, sample: int = 20_000, most_features: int = 4096, most_voters: int = 400) -> ToxicityModel:
    """A model from ``labels`` (doc_id, toxic) and their texts. Runs jobs; the driver holds what the bounds allow."""
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # ``sample`` rows at most, so it may be sent to every task.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    train = stored(texts.dropDuplicates(["text"]).select("text", "toxic"), "toxicity-train")
    size, marked = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not marked or marked == size:
        bias = 30.0 if size and marked else -30.0
        return ToxicityModel(np.zeros(0, np.uint64), [], np.zeros(0), bias, [], None)
    counts = feature_counts(train).filter(F.col("marked") + F.col("unmarked") >= LEAST_DOCS)
    # How far the marked documents with a feature exceed their share, in standard deviations.
    share = marked / size
    every = F.col("marked") + F.col("unmarked")
    surprise = (F.col("marked") - every * share) / F.sqrt(every * share * (1 - share))
    best = counts.withColumn("surprise", surprise).orderBy(F.abs("surprise").desc(), "hash").limit(most_features).toPandas()
    best["hash"] = best["hash"].to_numpy(np.int64).astype(np.uint64)
    best = best.sort_values("hash").reset_index(drop=True)
    hashes = best["hash"].to_numpy(np.uint64)
    names = [bytes(n).decode(errors="replace") for n in best["name"]]
    rows = documents_features(train, hashes).toPandas()
    features, labels_of = [np.asarray(f, np.int64) for f in rows["features"]], rows["toxic"].to_numpy()
    n, p = best["marked"] + best["unmarked"], best["marked"] / (best["marked"] + best["unmarked"])
    z = 1.2816
    surely = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    precise = best[(best["surprise"] >= LEAST_SURPRISE) & (surely >= LEAST_SHARE)]
    voters = precise.sort_values(["surprise", "hash"], ascending=[False, True]).index.to_numpy()[:most_voters]
    column = np.full(len(hashes), -1)
    column[voters] = np.arange(len(voters))
    votes = np.zeros((len(features), len(voters)), np.uint8)
    for n, f in enumerate(features):
        fired = column[f]
        votes[n, fired[fired >= 0]] = 1
    model, posterior = fit_label_model(votes, labels_of)
    weights, bias = fit_linear(features, len(hashes), posterior)
    used = np.flatnonzero(weights)
    return ToxicityModel(hashes[used], [names[i] for i in used], weights[used], bias, [names[i] for i in voters], model)


class Scorer:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.hashes, self.weights, self.bias, self.hasher = hashes, weights, bias, Hasher()

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        owner, feature = present(data, offsets, self.hashes, self.hasher)
        margin = self.bias + np.bincount(owner, self.weights[feature], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def score(df: DataFrame, model: ToxicityModel, id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every row: the classifier's probability for the whole text."""
    hashes, weights, bias = model.hashes, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(hashes, weights, bias)
        for batch in batches:
            for first, end, data, offsets in slices(lowered(batch)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(scorer.score(data, offsets))], ["id", "score"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("id"), df["text"]).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)


def keep_below(df: DataFrame, model: ToxicityModel, limit: float) -> DataFrame:
    """The rows of ``df`` whose score is below ``limit``, with all their columns."""
    hashes, weights, bias = model.hashes, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(hashes, weights, bias)
        for batch in batches:
            for first, end, data, offsets in slices(lowered(batch)):
                yield batch.slice(first, end - first).filter(pa.array(scorer.score(data, offsets) < limit))

    return df.mapInArrow(run, df.schema)
