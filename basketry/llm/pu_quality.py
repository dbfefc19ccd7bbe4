"""Quality by positive-unlabelled learning: trusted positives, unlabelled web text, and a class prior estimated from both.

There are no negatives. The classifier minimises the non-negative unbiased risk

    prior * risk(positives as good) + max(0, risk(unlabelled as bad) - prior * risk(positives as bad))

with the logistic loss. Where the second part falls below zero the model has begun to fit the single texts, and the step goes back
up. Scores are therefore probabilities that a text drawn from the corpus is good.

The prior is a statistic of all documents. Texts are on one of two sides, by their hash, and each side has a first classifier that
tells its positives from its unlabelled texts; positives and all documents are scored by the other side's, which has not seen them, and
counted between 1,000 bars. The share of documents above a bar over the share of positives there bounds the prior from above; the
bar at which the bound with its margin of error is lowest gives it.

Features of a text: measures of its style (lengths, shares of kinds of characters, repeated words, windows and lines), each cut into
ranges, and hashed words and word shapes. The classifiers are fitted on at most about ``sample`` positives and about as many
drawn documents; these bound the driver too. All texts are scored whole. Labels, language, source and doc_id are no inputs of a score.

Defined results: null and empty texts have the score of a text without characters; rows with equal texts have equal scores; an id with
contrary labels is not trusted; rows without id are scored, but are no positives; without positives every score is below 1e-17; an empty table
gives an empty table. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import IS_SPACE, LOWER, U64, Hasher, mix, slices, stored, word_bounds

# Kinds of bytes: their shares are features, and a word's shape is the sequence of kinds without repeats.
KINDS = ("lower", "upper", "digit", "beyond", "space", "line", "stop", "mark", "quote", "symbol", "bracket", "bar", "other")
KIND = np.full(256, KINDS.index("other"), np.uint8)
KIND[ord("a") : ord("z") + 1] = 0
KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("0") : ord("9") + 1] = 2
KIND[128:] = 3
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
for _number, _bytes in ((5, b"\n"), (6, b".,;:"), (7, b"!?"), (8, b"'\"`-"), (9, b"#*$%&@~^_+=\\"), (10, b"()[]{}<>"), (11, b"|/")):
    KIND[list(_bytes)] = _number
NO_LINE = np.zeros(256, bool)
NO_LINE[10] = True
WORD_BUCKETS, SHAPE_BUCKETS = 2048, 1024
RANGES = 12
BARS = 1000
STYLE = len(KINDS) + 10


def _distinct(owner: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of different values and the highest count of one; then owner and value of each."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(o)))
    most = np.zeros(size, np.int64)
    np.maximum.at(most, o[at], times)
    return np.bincount(o[at], minlength=size), most, o[at], v[at]


def style_and_words(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each text (texts by ``STYLE``), then text and bucket of its hashed words and shapes, once each."""
    size = len(offsets) - 1
    lengths = np.diff(offsets)
    of_byte = np.repeat(np.arange(size), lengths)
    kinds = np.bincount(of_byte * len(KINDS) + KIND[data], minlength=size * len(KINDS)).reshape(size, len(KINDS))
    starts, ends, owner = word_bounds(data, offsets)
    n_words = np.bincount(owner, minlength=size)
    hasher.prepare(LOWER[data])
    words = hasher.spans(starts, ends)
    different, most, word_owner, word = _distinct(owner, words, size)
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    again = np.flatnonzero((owner[1:] == owner[:-1]) & (words[1:] == words[:-1]))
    windows = mix(words[inside] ^ mix(words[inside + 1] + U64(1)) ^ mix(words[inside + 2] + U64(2)))
    n_windows = np.bincount(owner[inside], minlength=size)
    different_windows = _distinct(owner[inside], windows, size)[0]
    line_starts, line_ends, line_owner = word_bounds(data, offsets, NO_LINE)
    n_lines = np.bincount(line_owner, minlength=size)
    different_lines = _distinct(line_owner, hasher.spans(line_starts, line_ends), size)[0]
    # Shapes: the kinds of a word's bytes without repeats.
    kind = KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    place = np.append(0, np.cumsum(change))
    hasher.prepare(kind[change])
    shapes = hasher.spans(place[starts], place[ends])
    plain = (KIND[data[ends - 1]] <= 3) if len(ends) else np.zeros(0, bool)
    shape_different, _, shape_owner, shape = _distinct(owner, shapes, size)
    per = lambda part, whole: part / np.maximum(whole, 1)
    style = np.column_stack(
        [
            per(kinds, lengths[:, None]),
            np.log1p(lengths),
            np.log1p(n_words),
            per(lengths - kinds[:, 4] - kinds[:, 5], n_words),
            per(different, n_words),
            per(most, n_words),
            per(different_windows, n_windows),
            per(different_lines, n_lines),
            per(np.bincount(owner, plain, minlength=size), n_words),
            per(shape_different, n_words),
            per(np.bincount(owner[again], minlength=size), n_words),
        ]
    )
    word_bucket = (mix(word + U64(7)) % U64(WORD_BUCKETS)).astype(np.int64)
    shape_bucket = WORD_BUCKETS + (mix(shape + U64(9)) % U64(SHAPE_BUCKETS)).astype(np.int64)
    buckets = WORD_BUCKETS + SHAPE_BUCKETS
    both = np.unique(np.concatenate([word_owner, shape_owner]) * buckets + np.concatenate([word_bucket, shape_bucket]))
    return style, both // buckets, both % buckets


@dataclass
class Sparse:
    """Rows of features with values, as (row, column, value) in row order."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    size: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns] * self.values, minlength=self.size)

    def back(self, slopes: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, slopes[self.rows] * self.values, minlength=width)


@dataclass
class Ranges:
    """The edges that cut each measure of style into ranges."""

    edges: list[np.ndarray]

    @staticmethod
    def of(style: np.ndarray) -> Ranges:
        share = np.linspace(0, 1, RANGES + 1)[1:-1]
        edges = []
        for column in style.T:
            some = column[column > 0]
            more = np.quantile(some, [0, 0.25, 0.5, 0.75]) if len(some) else []
            edges.append(np.unique(np.concatenate([np.quantile(column, share), more])))
        return Ranges(edges)

    @property
    def width(self) -> int:
        return sum(len(e) + 1 for e in self.edges) + WORD_BUCKETS + SHAPE_BUCKETS

    def features(self, style: np.ndarray, owner: np.ndarray, bucket: np.ndarray) -> Sparse:
        size, first, columns = len(style), 0, []
        for column, edges in zip(style.T, self.edges):
            columns.append(first + np.searchsorted(edges, column, side="right"))
            first += len(edges) + 1
        # The words of a text together weigh as much as its measures of style.
        value = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=size), 1))
        return Sparse(
            np.concatenate([np.tile(np.arange(size), len(columns)), owner]),
            np.concatenate([*columns, first + bucket]).astype(np.int64),
            np.concatenate([np.ones(size * len(columns)), value[owner]]),
            size,
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk for the margins of both kinds of texts; the second one may not be negative."""
    return prior * float(_softplus(-positive).mean()), float(_softplus(unlabelled).mean()) - prior * float(_softplus(positive).mean())


def fit_linear(positive: Sparse, unlabelled: Sparse, width: int, prior: float | None, steps: int = 250, penalty: float = 1e-5) -> np.ndarray:
    """Weights, the last one the bias, by Adam on the non-negative risk; without a prior, on telling the two kinds apart."""
    weights = np.zeros(width + 1)
    mean, square = np.zeros(width + 1), np.zeros(width + 1)

    def slope(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        part = positive.back(p / positive.size, width) + unlabelled.back(u / unlabelled.size, width)
        return np.append(part, p.mean() + u.mean())

    for step in range(1, steps + 1):
        p = positive.times(weights[:-1]) + weights[-1]
        u = unlabelled.times(weights[:-1]) + weights[-1]
        if prior is None:
            gradient = slope(-_sigmoid(-p), _sigmoid(u))
        elif risk(p, u, prior)[1] >= 0:
            gradient = slope(-prior * _sigmoid(-p) - prior * _sigmoid(p), _sigmoid(u))
        else:
            gradient = -slope(-prior * _sigmoid(p), _sigmoid(u))
        gradient[:-1] += penalty * weights[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        rate = 0.1 * (1 - step / (steps + 1))
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def prior_from_counts(positives: np.ndarray, documents: np.ndarray, errors: float = 3.0) -> float:
    """The class prior from how many positives and how many documents score in each range, lowest range first.

    The share of documents above a bar over that of positives bounds the prior from above; the bar is the one where that bound is
    lowest with both shares off by ``errors`` standard errors.
    """
    n_p, n_u = positives.sum(), documents.sum()
    if not n_p or not n_u:
        return 0.5

    def share(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        above = counts[::-1].cumsum()
        smooth = (above + 1) / (n + 2)
        return above / n, errors * np.sqrt(smooth * (1 - smooth) / n)

    (above_p, error_p), (above_u, error_u) = share(positives, n_p), share(documents, n_u)
    # Bars above which too few positives are left to tell are passed over.
    sure = np.flatnonzero(above_p > 4 * error_p)
    if not len(sure):
        return 0.5
    at = sure[((above_u + error_u)[sure] / (above_p - error_p)[sure]).argmin()]
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


@dataclass
class QualityModel:
    ranges: Ranges
    weights: np.ndarray
    prior: float

    def of(self, features: Sparse) -> np.ndarray:
        return _sigmoid(features.times(self.weights[:-1]) + self.weights[-1])

    def score(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
        return self.of(self.ranges.features(*style_and_words(data, offsets, hasher)))


def _sides(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """0 or 1 by the hash of each whole text, so that equal texts are on one side."""
    hasher.prepare(data)
    return (mix(hasher.spans(offsets[:-1], offsets[1:])) & U64(1)).astype(np.int64)


def _measured(df: DataFrame) -> DataFrame:
    """(style array<double>, buckets array<int>, side int) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                style, owner, bucket = style_and_words(data, offsets, hasher)
                size = end - first
                edges = np.append(0, np.cumsum(np.bincount(owner, minlength=size))).astype(np.int32)
                fixed = np.arange(0, size * STYLE + 1, STYLE, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(fixed), pa.array(style.ravel())),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(bucket.astype(np.int32))),
                        pa.array(_sides(data, offsets, hasher).astype(np.int32)),
                    ],
                    ["style", "buckets", "side"],
                )

    return df.select("text").mapInArrow(run, "style array<double>, buckets array<int>, side int")


@dataclass
class Texts:
    """A bounded table of measured texts, on the driver."""

    style: np.ndarray
    owner: np.ndarray
    bucket: np.ndarray
    side: np.ndarray

    @staticmethod
    def of(rows: DataFrame) -> Texts:
        table = rows.toPandas()
        style = np.array([np.asarray(s, float) for s in table["style"]]).reshape(-1, STYLE)
        sizes = [len(b) for b in table["buckets"]]
        bucket = np.concatenate([np.zeros(0, np.int64), *[np.asarray(b, np.int64) for b in table["buckets"]]])
        return Texts(style, np.repeat(np.arange(len(sizes)), sizes), bucket, table["side"].to_numpy(np.int64))

    @property
    def size(self) -> int:
        return len(self.style)

    def part(self, chosen: np.ndarray) -> Texts:
        number = np.cumsum(chosen) - 1
        keep = chosen[self.owner]
        return Texts(self.style[chosen], number[self.owner[keep]], self.bucket[keep], self.side[chosen])

    def features(self, ranges: Ranges) -> Sparse:
        return ranges.features(self.style, self.owner, self.bucket)


def fit(documents: DataFrame, positives: DataFrame, sample: int = 8_000, id_column: str = "doc_id", seed: int = 11) -> QualityModel:
    """A model from the texts of ``positives`` (doc_id) among ``documents`` and from all documents. Runs jobs."""
    chosen = positives.filter(F.col(id_column).isNotNull()).select(id_column).distinct().orderBy(F.xxhash64(id_column), id_column).limit(sample)
    # ``sample`` ids at most, so they may be sent to every task. Where ids repeat, their rows are drawn from once more.
    trusted = documents.select(id_column, "text").join(F.broadcast(chosen), id_column)
    known = stored(_measured(trusted).withColumn("drawn", F.rand(seed)), "pu-positives")
    n_known, n_documents = known.count(), documents.count()
    if not n_known:
        return QualityModel(Ranges([np.zeros(0)] * STYLE), np.append(np.zeros(STYLE + WORD_BUCKETS + SHAPE_BUCKETS), -np.inf), 0.0)
    positive = Texts.of(known.filter(F.col("drawn") < sample / n_known))
    drawn = documents.select("text").filter(F.rand(seed + 1) < sample / n_documents)
    unlabelled = Texts.of(stored(_measured(drawn), "pu-unlabelled"))
    return fit_texts(positive, unlabelled, lambda models: _document_bars(documents, models))


def fit_texts(positive: Texts, unlabelled: Texts, count: Callable[[list[QualityModel]], np.ndarray]) -> QualityModel:
    """The model of bounded tables; ``count`` gives how many documents lie between bars, each scored by the model of the other side."""
    ranges = Ranges.of(np.vstack([positive.style, unlabelled.style]))
    everything = unlabelled.features(ranges)
    first, bars = [], np.zeros(BARS, np.int64)
    for side in (0, 1):
        seen, near = positive.part(positive.side == side), unlabelled.part(unlabelled.side == side)
        weights = np.zeros(ranges.width + 1)
        if seen.size and near.size:
            weights = fit_linear(seen.features(ranges), near.features(ranges), ranges.width, None, steps=120)
        first.append(QualityModel(ranges, weights, 0.0))
        bars += _bars(first[side].of(positive.part(positive.side != side).features(ranges)))
    prior = prior_from_counts(bars, count(first))
    if not everything.size:
        everything = positive.features(ranges)
    return QualityModel(ranges, fit_linear(positive.features(ranges), everything, ranges.width, prior), prior)


def _bars(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((scores * BARS).astype(np.int64), BARS - 1), minlength=BARS)


def _document_bars(documents: DataFrame, models: list[QualityModel]) -> np.ndarray:
    """How many documents score in each of the ranges between bars, each by the model of the side it is not on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(), np.zeros(BARS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch):
                features = models[0].ranges.features(*style_and_words(data, offsets, hasher))
                side = _sides(data, offsets, hasher)
                counts += _bars(np.where(side == 0, models[1].of(features), models[0].of(features)))
        bar = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(bar), pa.array(counts[bar])], ["bar", "n"])

    out = np.zeros(BARS, np.int64)
    for r in documents.select("text").mapInArrow(run, "bar long, n long").groupBy("bar").agg(F.sum("n").alias("n")).collect():
        out[r["bar"]] = r["n"]
    return out


def score(df: DataFrame, model: QualityModel, id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every row: the probability that the whole text is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(model.score(data, offsets, hasher))], ["id", "score"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column].alias("id"), df["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)
