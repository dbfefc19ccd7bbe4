"""Boosted ranking trees with NDCG gradients, all folds at once.

The candidates of a user are one row: labels, binned features (one byte each) and fold. Every pass over these rows is a pure function of
the rows and of the trees grown so far: a task scores its users with the fold models, forms the pairs of better and worse
candidates inside a user, weighs each by what swapping the two would change in NDCG, and adds gradients and curvatures up per node,
feature and bin. Only these histograms are shuffled, and the driver, which holds nodes x features x bins numbers, picks
the splits. One pass serves one level of the trees of all folds; of two sisters only the left one is counted. Gradients are summed as
whole numbers, so models do not depend on how rows are dealt out.

Scores are stored with the rows every ``refresh`` trees, so that a pass never evaluates more trees than that.

A user's candidates are bounded by their construction (some tens per model). Users without a pair add nothing. Nulls among features
count as zero, labels must not be null; an empty table gives models without trees and no scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.distributed import top_rows
from basketry.runtime import cut, require_positive

PLACES = 9
# Gradients are whole multiples of this.
UNIT = 2.0**-28
# Users whose candidates are worked on at a time, so that they stay in a processor's cache.
SLICE = 2048
USERS = "user_id {kind}, fold int, item_ids array<{item}>, labels array<double>, bins binary, scores binary"


@dataclass
class Tree:
    """A tree as a heap: node n has the children 2n + 1 and 2n + 2; ``feature`` is -1 where it ends."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def of(depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def nodes(self, columns: np.ndarray) -> np.ndarray:
        """The node in which each row ends; ``columns`` holds features x rows, so that a node compares one run of bytes."""
        at = np.zeros(columns.shape[1], np.int16 if len(self.feature) < 1 << 15 else np.int64)
        for node in np.flatnonzero(self.feature >= 0).tolist():
            right = columns[self.feature[node]] > int(self.cut[node])
            at += (at == node) * (right + at.dtype.type(node + 1))
        return at

    def scores(self, columns: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(columns)]


@dataclass
class RankingModel:
    """Trees over binned features. A value falls into the bin that counts the edges below it."""

    names: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> np.ndarray:
        features = np.nan_to_num(features, nan=0.0)
        out = np.zeros(features.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, features[:, j], side="left")
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.scores_of_columns(np.ascontiguousarray(bins.T))

    def scores_of_columns(self, columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1])
        for tree in self.trees:
            out += tree.scores(columns)
        return out


@dataclass
class Settings:
    trees: int = 60
    depth: int = 4
    step: float = 0.1
    least_leaf: int = 20
    ridge: float = 1.0
    feature_share: float = 0.8
    user_share: float = 0.8
    patience: int = 10
    k: int = 10
    bins: int = 64
    refresh: int = 10
    seed: int = 42


def feature_edges(table: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cuts between bins of about equal size for each entry of ``features``, in one pass of sketches."""
    shares = [i / bins for i in range(1, bins)]
    values = vector_to_array("features")
    found = table.select(values.alias("_x")).agg(
        *[F.percentile_approx(F.col("_x")[j], shares, 10_000).alias(f"_e{j}") for j in range(width)]
    ).first()
    return [np.unique(np.array(e or [], float)) for e in found]


def user_rows(table: DataFrame, model: RankingModel, folds: int) -> DataFrame:
    """One stored row per user with all candidates, in the order of their ids."""
    kind, item = (table.schema[c].dataType.simpleString() for c in ("user_id", "item_id"))
    row = F.struct("item_id", F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    grouped = table.groupBy("user_id", "fold").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    flat = grouped.select("user_id", "fold", F.col("rows.item_id").alias("item_ids"), F.col("rows.label").alias("labels"), F.flatten("rows.x").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _lists(batch.column(4))
            rows, _ = _lists(batch.column(3))
            bins = model.bins(x.reshape(len(rows), -1))
            bounds = np.append(0, np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False)))
            parts = [bins[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            scores = [np.zeros((b - a, folds)).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [batch.column(i) for i in range(4)] + [pa.array(parts, pa.binary()), pa.array(scores, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["user_id", "fold", "item_ids", "labels", "bins", "scores"])

    return cut(flat.mapInArrow(run, USERS.format(kind=kind, item=item)))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


@dataclass
class Users:
    """A batch of users: candidates, user after user, and the pairs inside them. What no score changes is worked out once."""

    fold: np.ndarray
    owner: np.ndarray
    within: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    scores: np.ndarray
    better: np.ndarray
    worse: np.ndarray
    paired: np.ndarray
    logs: np.ndarray
    k: int
    ideal: np.ndarray
    pair_gain: np.ndarray
    pair_ideal: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, width: int, folds: int, k: int) -> Users:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        labels, sizes = _lists(get("labels"))
        start = np.append(0, np.cumsum(sizes)).astype(np.int64)
        # Sixteen bits where they do, as numpy sorts those in linear time.
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.int64), sizes)
        columns = np.ascontiguousarray(np.frombuffer(b"".join(get("bins").to_pylist()), np.uint8).reshape(-1, width).T)
        scores = np.frombuffer(b"".join(get("scores").to_pylist())).reshape(-1, folds)
        # Each candidate with a label above the least of its user meets all of its user; the better ones of unequal pairs stay.
        least = np.minimum.reduceat(labels, start[:-1]) if len(sizes) else labels
        up = np.flatnonzero(labels > least[owner]) if len(labels) else np.zeros(0, np.int64)
        counts = sizes[owner[up]] if len(up) else np.zeros(0, np.int64)
        better = np.repeat(up, counts)
        worse = np.arange(len(better)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start[owner[up]], counts)
        keep = labels[better] > labels[worse]
        better, worse = better[keep], worse[keep]
        has_pair = np.zeros(len(sizes), bool)
        has_pair[owner[better]] = True
        logs = np.log2(np.arange(sizes.max(initial=0)) + 2)
        none = np.zeros(0)
        out = Users(get("fold").to_numpy(zero_copy_only=False), owner, np.arange(len(labels)) - start[owner], labels, columns, scores, better, worse, has_pair[owner], logs, k, none, none, none)
        gains, places = out.gains(), out.places(labels)
        out.ideal = np.bincount(owner, gains * (places < k) / logs[places], minlength=len(sizes))
        full = np.bincount(owner, gains / logs[places], minlength=len(sizes))[owner[better]]
        out.pair_gain, out.pair_ideal = gains[better] - gains[worse], np.where(full > 0, full, np.inf)
        return out

    def gains(self) -> np.ndarray:
        return np.exp2(self.labels) - 1

    def places(self, by: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """0-based place of each candidate inside its user, highest first; ties stay in the order of ids. ``rows`` are those of whole users."""
        order = np.lexsort((-by[rows], self.owner[rows]))
        out = np.empty(len(order), np.int64)
        out[order] = self.within[rows]
        return out

    def ndcg(self, scores: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """NDCG of each user with a positive ideal; NaN for the others. Users outside ``rows`` get what is not theirs."""
        places = self.places(scores, rows)
        dcg = np.bincount(self.owner[rows], self.gains()[rows] * (places < self.k) / self.logs[places], minlength=len(self.ideal))
        return np.divide(dcg, self.ideal, out=np.full(len(dcg), np.nan), where=self.ideal > 0)

    def gradients(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature of the pairwise loss at each candidate; a pair weighs what its swap changes in NDCG."""
        a, b, size = self.better, self.worse, len(scores)
        discount = np.zeros(size)
        discount[self.paired] = 1 / self.logs[self.places(scores, self.paired)]
        weight = self.pair_gain * np.abs(discount[a] - discount[b]) / self.pair_ideal
        wrong = 1 / (1 + np.exp(np.clip(scores[a] - scores[b], -40, 40)))
        slope, curve = weight * wrong, weight * wrong * (1 - wrong)
        g = np.bincount(b, slope, minlength=size) - np.bincount(a, slope, minlength=size)
        return g, np.bincount(a, curve, minlength=size) + np.bincount(b, curve, minlength=size)


def _drawn(batch: pa.RecordBatch, tree: int, share: float, seed: int) -> np.ndarray:
    """Which users of a batch take part in a tree, by a hash of the id."""
    if share >= 1:
        return np.ones(batch.num_rows, bool)
    ids = pd.util.hash_array(pd.Series(batch.column(0).to_pandas()).astype(str).to_numpy(object)).astype(np.uint64)
    mixed = (ids ^ np.uint64(seed * 1_000_003 + tree + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)).astype(float) / 2.0**53 < share


def _add_histograms(sums: np.ndarray, group: Users, use: np.ndarray, place: np.ndarray, scores: np.ndarray) -> None:
    """Add slopes, curvatures and numbers of the rows in use to ``sums``: nodes x features x bins x 3, a feature at a time.

    Candidates of users without pairs have neither slope nor curvature, and are only counted.
    """
    nodes, width, bins, _ = sums.shape
    g, h = group.gradients(scores)
    some = np.flatnonzero(use & group.paired)
    rows = np.concatenate([some, np.flatnonzero(use & ~group.paired)])
    base, columns = place[rows].astype(np.int64) * bins, group.columns[:, rows]
    weights = [np.round(x[some] / UNIT) for x in (g, h)]
    for feature in range(width):
        at = base + columns[feature]
        for i, value in enumerate(weights):
            sums[:, feature, :, i] += np.bincount(at[: len(some)], value, minlength=nodes * bins).astype(np.int64).reshape(nodes, bins)
        sums[:, feature, :, 2] += np.bincount(at, minlength=nodes * bins).reshape(nodes, bins)


def _level(users: DataFrame, models: Sequence[RankingModel], growing: Sequence[Tree | None], level: int, number: int, s: Settings) -> dict:
    """Histograms of the left (or only) nodes of a level for every fold that still grows: {(fold, node): features x bins x 3}.

    With them come, at level 0, sum and number of the NDCG of each fold's own users.
    """
    folds, width = len(models), len(models[0].names)
    first = 2**level - 1
    wanted = [0] if level == 0 else list(range(first, 2 * first + 1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, len(wanted), width, s.bins, 3), np.int64)
        quality = np.zeros((folds, 2))
        for batch in (whole.slice(begin, SLICE) for whole in batches for begin in range(0, whole.num_rows, SLICE)):
            group = Users.of(batch, width, folds, s.k)
            drawn = _drawn(batch, number, s.user_share, s.seed)
            for fold in range(folds):
                tree = growing[fold]
                if tree is None and level:
                    continue
                scores = group.scores[:, fold] + models[fold].scores_of_columns(group.columns)
                if level == 0:
                    own = group.fold == fold
                    ndcg = group.ndcg(scores, own[group.owner])[own]
                    quality[fold] += np.nansum(ndcg), np.isfinite(ndcg).sum()
                if tree is None:
                    continue
                node = tree.nodes(group.columns)
                use = (drawn & (group.fold != fold))[group.owner]
                use &= (node >= first) & ((node - first) % 2 == 0) if level else True
                if use.any():
                    _add_histograms(sums[fold], group, use, (node - first) // 2 if level else node, scores)
        flat = sums.reshape(-1, 3)
        at = np.flatnonzero(flat.any(axis=1))
        whole = np.round(quality / UNIT).astype(np.int64)
        key = np.concatenate([at, -1 - np.arange(folds)])
        columns = np.concatenate([flat[at], np.column_stack([whole, np.zeros(folds, np.int64)])])
        yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(np.ascontiguousarray(c)) for c in columns.T]], ["key", "g", "h", "n"])

    # Ids of items are of no use here, and lists are costly to hand over.
    found = users.drop("item_ids").mapInArrow(run, "key long, g long, h long, n long").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    rows = found.toPandas()
    flat, quality = np.zeros((folds * len(wanted) * width * s.bins, 3)), np.zeros((folds, 2))
    inner = rows["key"].to_numpy() >= 0
    flat[rows["key"].to_numpy()[inner]] = rows[["g", "h", "n"]].to_numpy(float)[inner] * [UNIT, UNIT, 1.0]
    outer = rows[~inner]
    quality[-1 - outer["key"].to_numpy(np.int64)] = outer[["g", "h"]].to_numpy(float) * UNIT
    sums = flat.reshape(folds, len(wanted), width, s.bins, 3)
    return {"quality": quality, "sums": {(f, n): sums[f, i] for f in range(folds) for i, n in enumerate(wanted)}}


def _best_split(sums: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) of the best split of a node; gain 0 if there is none."""
    left = sums.cumsum(axis=1)[:, :-1]
    total = sums[0].sum(axis=0)
    right = total - left
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.ridge)
    gain = worth(left) + worth(right) - worth(total)
    enough = (left[..., 2] >= s.least_leaf) & (right[..., 2] >= s.least_leaf) & allowed[:, None]
    gain = np.where(enough, gain, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def rerank_lambda(table: DataFrame, names: Sequence[str], folds: int = 5, settings: Settings | None = None) -> tuple[DataFrame, list[RankingModel]]:
    """Out-of-fold scores ``(user_id, item_id, label, fold, score)`` of boosted ranking trees, and one model per left-out fold.

    ``table`` is that of ``rerank.training_table``. A fold stops when the NDCG of its own users has not risen for ``patience`` trees,
    and keeps the trees up to its best. Runs a job per level of a tree.
    """
    s = settings or Settings()
    require_positive(folds=folds, trees=s.trees, depth=s.depth, bins=s.bins, refresh=s.refresh)
    names = list(names)
    edges = feature_edges(table, len(names), min(s.bins, 256))
    users = user_rows(table, RankingModel(names, edges), folds)
    models = [RankingModel(names, edges) for _ in range(folds)]
    recent = [RankingModel(names, edges) for _ in range(folds)]
    best, best_at, grows = np.full(folds, -1.0), np.zeros(folds, int), np.ones(folds, bool)
    draw = np.random.default_rng(s.seed)
    for number in range(s.trees + 1):
        if number and number % s.refresh == 0:
            users, recent = _refreshed(users, recent), [RankingModel(names, edges) for _ in range(folds)]
        allowed = np.ones(len(names), bool)
        if s.feature_share < 1:
            allowed[:] = False
            allowed[draw.permutation(len(names))[: max(1, round(s.feature_share * len(names)))]] = True
        trees: list[Tree | None] = [Tree.of(s.depth) if g and number < s.trees else None for g in grows]
        nodes: dict = {}
        for level in range(s.depth):
            found = _level(users, recent, trees, level, number, s)
            if level == 0:
                for fold, (total, count) in enumerate(found["quality"]):
                    ndcg = total / count if count else 0.0
                    # A model has one tree at least.
                    if grows[fold] and number and ndcg > best[fold]:
                        best[fold], best_at[fold] = ndcg, len(models[fold].trees)
                    elif grows[fold] and len(models[fold].trees) - best_at[fold] >= s.patience:
                        grows[fold], trees[fold] = False, None
            if not any(t is not None for t in trees):
                break
            nodes = _with_sisters(found["sums"], nodes, level)
            if not _grow(trees, nodes, level, allowed, s):
                break
        for fold, tree in enumerate(trees):
            if tree is not None:
                models[fold].trees.append(tree)
                recent[fold].trees.append(tree)
        if not grows.any():
            break
    models = [RankingModel(names, edges, m.trees[: best_at[f]]) for f, m in enumerate(models)]
    return out_of_fold(users, models), models


def _with_sisters(found: dict, above: dict, level: int) -> dict:
    """Histograms of all nodes of a level: a right node is its parent less its sister."""
    if level == 0:
        return found
    out = {}
    for (fold, node), sums in found.items():
        parent = (fold, (node - 1) // 2)
        if parent in above:
            out[fold, node], out[fold, node + 1] = sums, above[parent] - sums
    return out


def _grow(trees: Sequence[Tree | None], nodes: dict, level: int, allowed: np.ndarray, s: Settings) -> bool:
    """Split the nodes of a level where that helps and set their children's values; True if any was split."""
    split = False
    for (fold, node), sums in nodes.items():
        tree = trees[fold]
        if tree is None or (node and tree.feature[(node - 1) // 2] < 0):
            continue
        gain, feature, cut_at = _best_split(sums, allowed, s)
        if gain <= 1e-9:
            continue
        tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut_at, gain
        left = sums[feature, : cut_at + 1].sum(axis=0)
        for child, part in ((2 * node + 1, left), (2 * node + 2, sums[feature].sum(axis=0) - left)):
            tree.value[child] = -s.step * part[0] / (part[1] + s.ridge)
        split = True
    return split


def _refreshed(users: DataFrame, recent: Sequence[RankingModel]) -> DataFrame:
    """The users with the scores of recent trees added to the stored ones."""
    folds, width = len(recent), len(recent[0].names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("scores")
            bins = [np.frombuffer(b, np.uint8).reshape(-1, width) for b in batch.column("bins").to_pylist()]
            rows = np.concatenate(bins) if bins else np.zeros((0, width), np.uint8)
            new = np.frombuffer(b"".join(batch.column("scores").to_pylist())).reshape(-1, folds) + np.column_stack([m.scores(rows) for m in recent])
            bounds = np.append(0, np.cumsum([len(b) for b in bins])).astype(int)
            scores = pa.array([new[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield batch.set_column(at, "scores", scores)

    return cut(users.mapInArrow(run, users.schema))


def out_of_fold(users: DataFrame, models: Sequence[RankingModel]) -> DataFrame:
    """Each user's candidates scored by the model that has not seen the user."""
    kind, item = users.schema["user_id"].dataType.simpleString(), users.schema["item_ids"].dataType.elementType.simpleString()
    width = len(models[0].names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("labels").value_lengths().to_numpy(zero_copy_only=False)
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)[owner]
            score = np.zeros(len(bins))
            for number, model in enumerate(models):
                mine = fold == number
                score[mine] = model.scores(bins[mine])
            columns = [batch.column("user_id").take(pa.array(owner)), batch.column("item_ids").flatten(), batch.column("labels").flatten()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fold.astype(np.int32)), pa.array(np.round(score, PLACES))], ["user_id", "item_id", "label", "fold", "score"])

    return users.mapInArrow(run, f"user_id {kind}, item_id {item}, label double, fold int, score double")


def score_ranking_average(table: DataFrame, models: Sequence[RankingModel], n: int = 50) -> DataFrame:
    """Mean score of the fold models for ``rerank.scoring_table``, best ``n`` per user."""
    kind, item = (table.schema[c].dataType.simpleString() for c in ("user_id", "item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _lists(batch.column(2))
            bins = models[0].bins(x.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, 1), np.uint8)
            score = sum(m.scores(bins) for m in models) / len(models)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, PLACES))], ["user_id", "item_id", "score"])

    scored = table.select("user_id", "item_id", vector_to_array("features").alias("x")).mapInArrow(run, f"user_id {kind}, item_id {item}, score double")
    return top_rows(scored, ["user_id"], [F.desc("score"), F.asc("item_id")], n)


def ranking_gain(models: Sequence[RankingModel], spark: SparkSession, n: int = 20) -> DataFrame:
    """Gain of each feature's splits averaged over the fold models, the ``n`` largest."""
    total = np.zeros(len(models[0].names))
    for model in models:
        for tree in model.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner] / len(models))
    rows = [(name, float(g)) for name, g in zip(models[0].names, total)]
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), F.asc("feature")).limit(n)


def save_ranking_models(models: Sequence[RankingModel], spark: SparkSession, path: str) -> None:
    """One row per fold model with names, edges and trees; a folder that is there already is not overwritten."""
    rows = [
        (fold, m.names, [e.tolist() for e in m.edges], [(t.feature.tolist(), t.cut.tolist(), t.value.tolist(), t.gain.tolist()) for t in m.trees])
        for fold, m in enumerate(models)
    ]
    tree = "array<struct<feature:array<int>,cut:array<long>,value:array<double>,gain:array<double>>>"
    spark.createDataFrame(rows, f"fold int, names array<string>, edges array<array<double>>, trees {tree}").write.parquet(path)


def load_ranking_models(spark: SparkSession, path: str) -> list[RankingModel]:
    out = []
    for r in spark.read.parquet(path).orderBy("fold").collect():
        trees = [Tree(np.array(t["feature"], int), np.array(t["cut"], np.int64), np.array(t["value"]), np.array(t["gain"])) for t in r["trees"]]
        out.append(RankingModel(list(r["names"]), [np.array(e) for e in r["edges"]], trees))
    return out
