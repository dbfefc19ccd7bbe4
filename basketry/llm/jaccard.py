"""Jaccard join of word n-gram sets, light and heavy sets apart, and the groups that its links form.

A set of at most ``boundary`` shingles is light. For two light sets of sizes n and m, a link needs ``c(n, m)`` shingles in
common, so each set enumerates its subsets of just these sizes and looks for equals. Larger sets are heavy: they are found by
scanning inverted lists. A list belongs not to one shingle, as a common one's list would hold a share of the corpus, but to the
shingles of a set that fall into one of ``parts`` blocks of the hashed universe. Two linked sets differ in at most ``k``
shingles and so agree on ``parts - k`` blocks or more; lists of blocks that are empty in a set are left out unless the
set has so many that it might agree with another on nothing else. The boundary is where enumerating subsets would cost more
keys than lists and the comparisons of sets that they call for.

Sets in the same list are candidates, and every link is checked on the whole sets. Equal sets are one class from the start.
First each list's classes are compared with its least class; the links found join classes into components. Then only those
classes of a list are compared that are still in different components, and a pair that shares many lists is named in one of
them. No link between components is lost, and a group of thousands of near copies costs a comparison or so for each, not one
for each pair. Sets that share a list but differ in too
much are told by parity sketches before they are compared: the sketches of two sets differ in no more bits than the sets do
in shingles, so a pair whose sketches differ in more than a link allows is surely none. Sketches grow with the differences
that a link allows, four bits for each, so they tell long texts as well as short ones.

Shingles are compared by 64-bit hashes. ``n_shingles`` and links refer to distinct shingles.

Defined results: texts without words, and null texts, have no shingles, and their component is their own doc_id; texts with
fewer words than ``words`` have one shingle; rows with equal texts are one class; a row without doc_id takes part, and its
component is the smallest doc_id of the others, or null; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import LOWER, U64, Hasher, mix, slices, stored, word_bounds
from basketry.llm.components import components
from basketry.operators.distributed import sorted_index
from basketry.runtime import unused

GROWTH = 1.3
# Levels fit into six bits of a key; the last number marks keys of light sets.
LIGHT = 63
SKETCH_LONGS = 8
SKETCH = [f"s{n}" for n in range(SKETCH_LONGS)]
BITS_PER_DIFFERENCE = 4
# So many of a set's lists, in the order of their keys, go with it to tell where a pair is named.
FIRST_LISTS = 16
STEP = U64(0x9E3779B97F4A7C15)
BITMAP_WORDS = 1 << 21
# Labels of classes without doc_id lie above this one.
NO_ID = (1 << 63) - (1 << 41)


class Scheme:
    """Which keys a set of each size gets, for links at ``num/den`` or more."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.boundary = 0
        while self.boundary < 64 and self._light_cost(self.boundary + 1) <= self._heavy_cost(self.boundary + 1):
            self.boundary += 1
        # Sizes from which a set may be linked with a heavy one; the levels begin there.
        self.least = self.partner_sizes(self.boundary + 1)[0]
        self.levels = [self.least]

    def overlap(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def partner_sizes(self, n: int) -> tuple[int, int]:
        return max(1, -(-self.num * n // self.den)), self.den * n // self.num

    def subset_sizes(self, n: int) -> list[int]:
        low, high = self.partner_sizes(n)
        return sorted({c for m in range(low, high + 1) if (c := self.overlap(n, m)) <= min(n, m)})

    def _light_cost(self, n: int) -> int:
        return sum(math.comb(n, c) for c in self.subset_sizes(n))

    def _heavy_cost(self, n: int) -> int:
        return self.differences(n) + 1 + 2 * n

    def differences(self, n: int) -> int:
        return (self.den - self.num) * 2 * n // (self.den + self.num)

    def extend(self, most: int) -> None:
        while (self.levels[-3:][0] <= most or len(self.levels) < 4) and len(self.levels) <= LIGHT:
            last = self.levels[-1]
            self.levels.append(max(last + 1, int(last * GROWTH), self.partner_sizes(last)[1] + 1))

    def parts(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks in each level, and how many may be empty before empty ones count.

        Blocks less empty ones less the differences of a pair are the lists that it shares if it is linked: an eighth of
        the blocks at least. Half of that lets a set leave its longest lists out (see ``left_out``), the other half is asked
        for of every pair, so that chance does not make many.
        """
        needed = self.needed(level)
        spare = 1 + needed // 32
        return needed + 2 * (needed // 16) + spare, spare

    def needed(self, level: np.ndarray) -> np.ndarray:
        ends = np.array(self.levels[1:], np.int64)[level]
        return (self.den - self.num) * 2 * (ends - 1) // (self.den + self.num) + 1

    def left_out(self) -> list[int]:
        """By level, how many of its keys a set leaves out: those of the longest lists.

        Of the lists that a linked pair shares, the shortest ones stay in both sets, as lists are ordered alike for all sets.
        """
        self.extend(1 << 40)
        by_level = [int(n) for n in self.needed(np.arange(min(LIGHT, len(self.levels) - 1))) // 16]
        return by_level + by_level[-1:] * (LIGHT - len(by_level)) + [0]

    def agreeing(self, size: np.ndarray) -> np.ndarray:
        """For heavy sets the lists left that a linked pair of this larger size shares, and as many as it has differences."""
        heavy = size > self.boundary
        level = np.maximum(np.searchsorted(np.array(self.levels, np.int64), size, side="right") - 1, 0)
        parts, spare = self.parts(level)
        return np.where(heavy, parts - spare - self.needed(level) // 16, 0)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text and in order, and their number in each text."""
    data = LOWER[data]
    texts = len(offsets) - 1
    hasher.prepare(data)
    starts, ends, owner = word_bounds(data, offsets)
    hashes = hasher.spans(starts, ends)
    size = np.bincount(owner, minlength=texts)
    first = np.cumsum(size) - size
    runs = [np.zeros(0, np.uint64)]
    owners = [np.zeros(0, np.int64)]
    for length in range(1, words + 1):
        # Whole texts of fewer words, and all runs of the full length.
        at = first[size == length] if length < words else np.flatnonzero(owner[: len(owner) - words + 1] == owner[words - 1 :]) if len(owner) >= words else first[:0]
        value = np.full(len(at), length, np.uint64)
        for n in range(length):
            value = mix(value * STEP + hashes[at + n])
        runs.append(value)
        owners.append(owner[at])
    value, owner = np.concatenate(runs), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=texts)


def class_keys(shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each distinct set."""
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
    end = np.cumsum(size)
    return mix((sums[end] - sums[end - size]) * STEP + size.astype(np.uint64)).astype(np.int64)


def sketches(shingles: np.ndarray, size: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """For each set the parity of its shingles in each of 64 * longs buckets, as numbers of 64 bits."""
    bits = 64 * longs
    cell = np.repeat(np.arange(len(size)), size) * bits + (mix(shingles ^ U64(0x9FB21C651E98DF25)) % U64(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(size) * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(size), longs)


def long_sketches(scheme: Scheme, shingles: np.ndarray, size: np.ndarray) -> list[np.ndarray | None]:
    """Sketches of sets that may differ in so many shingles that the short sketch cannot tell: ``BITS_PER_DIFFERENCE`` bits for each.

    Lengths are powers of two, so that a longer one folds into a shorter one.
    """
    out: list[np.ndarray | None] = [None] * len(size)
    first = np.cumsum(size) - size
    for n in np.flatnonzero(BITS_PER_DIFFERENCE * scheme.differences(size) > 64 * SKETCH_LONGS).tolist():
        longs = 1 << (BITS_PER_DIFFERENCE * scheme.differences(int(size[n])) // 64).bit_length()
        out[n] = sketches(shingles[first[n] : first[n] + size[n]], size[n : n + 1], longs)[0]
    return out


def light_keys(scheme: Scheme, shingles: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for the subsets of light sets."""
    weight = mix(shingles ^ U64(0x14057B7EF767814F))
    first = np.cumsum(size) - size
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(size[(size > 0) & (size <= scheme.boundary)]).tolist():
        texts = np.flatnonzero(size == n)
        rows = weight[first[texts][:, None] + np.arange(n)]
        total = rows.sum(axis=1, dtype=np.uint64)
        for c in scheme.subset_sizes(n):
            left_out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(math.comb(n, c), n - c)
            sums = total[:, None] - rows[:, left_out].sum(axis=2, dtype=np.uint64)
            keys.append((mix(sums ^ mix(np.full(1, c, np.uint64))) | U64(LIGHT)).ravel())
            owners.append(np.repeat(texts, len(left_out)))
    return np.concatenate(owners), np.concatenate(keys)


def heavy_keys(scheme: Scheme, shingles: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for the blocks of sets that may be linked with heavy ones."""
    scheme.extend(int(size.max(initial=0)) + 1)
    levels = np.array(scheme.levels, np.int64)
    own = np.searchsorted(levels, size, side="right") - 1
    spread, weight = mix(shingles + STEP) >> U64(32), mix(shingles ^ U64(0x2545F4914F6CDD1D))
    text = np.repeat(np.arange(len(size)), size)
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for above in (0, 1):
        chosen = size >= scheme.least
        level = np.maximum(own, 0) + above
        if above:
            begin = np.array(scheme.levels, np.int64)[level]
            chosen &= scheme.den * size >= scheme.num * begin
        texts = np.flatnonzero(chosen)
        if not len(texts):
            continue
        parts, spare = scheme.parts(level[texts])
        base = np.zeros(len(size), np.int64)
        base[texts] = np.cumsum(parts) - parts
        count = np.zeros(len(size), np.uint64)
        count[texts] = parts
        mine = chosen[text]
        cell = base[text[mine]] + ((spread[mine] * count[text[mine]]) >> U64(32)).astype(np.int64)
        order = np.argsort(cell)
        cell = cell[order]
        begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sums, cell = np.add.reduceat(weight[mine][order], begins), cell[begins]
        owner = np.searchsorted(base[texts], cell, side="right") - 1
        hollow = np.flatnonzero(parts - np.bincount(owner, minlength=len(texts)) > spare)
        if len(hollow):
            rows = [np.setdiff1d(np.arange(base[texts[i]], base[texts[i]] + parts[i]), cell[owner == i]) for i in hollow]
            cell = np.concatenate([cell, *rows])
            sums = np.concatenate([sums, np.zeros(len(cell) - len(sums), np.uint64)])
            owner = np.concatenate([owner, np.repeat(hollow, [len(r) for r in rows])])
        block = (cell - base[texts[owner]]).astype(np.uint64)
        tag = mix(((level[texts[owner]].astype(np.uint64) + U64(1)) << U64(40)) + block)
        owners.append(texts[owner])
        keys.append((mix(sums ^ tag) & ~U64(LIGHT)) | level[texts[owner]].astype(np.uint64))
    return np.concatenate(owners), np.concatenate(keys)


def _marked(df: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, class, keys, sketch) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, scheme = Hasher(), Scheme(num, den)
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                shingles, size = shingle_sets(data, offsets, words, hasher)
                light, heavy = light_keys(scheme, shingles, size), heavy_keys(scheme, shingles, size)
                owner, key = (np.concatenate([a, b]) for a, b in zip(light, heavy))
                order = np.argsort(owner, kind="stable")
                bounds = np.zeros(end - first + 1, np.int32)
                np.cumsum(np.bincount(owner, minlength=end - first), out=bounds[1:])
                sketch = sketches(shingles, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(size.astype(np.int64)),
                        pa.array(class_keys(shingles, size)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(key[order].astype(np.int64))),
                        pa.array(scheme.agreeing(size).astype(np.int32)),
                        *(pa.array(sketch[:, n]) for n in range(SKETCH_LONGS)),
                        pa.array(long_sketches(scheme, shingles, size), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "class", "keys", "agreeing", *SKETCH, "wide"],
                )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, class long, keys array<long>, agreeing int" + "".join(f", {s} long" for s in SKETCH) + ", wide array<long>")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(class, n, shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for _, _, data, offsets in slices(batch):
                shingles, size = shingle_sets(data, offsets, words, hasher)
                bounds = np.append(0, np.cumsum(size)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(class_keys(shingles, size)), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(shingles.astype(np.int64)))],
                    ["class", "n", "shingles"],
                )

    return df.select("text").mapInArrow(run, "class long, n long, shingles array<long>")


def among(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among that of ``wanted``, and a few more: hashes are looked up in a bitmap.

    The bitmap has at most BITMAP_WORDS words however many values there are, so it may be sent to every task. With very many
    values it lets more rows through, and the join that follows drops them.
    """
    h = F.xxhash64(column)
    place = [F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP_WORDS - 1).alias("_word"), h.bitwiseAND(63).cast("int").alias("_bit")]
    one = F.lit(1).cast("long")
    marks = F.bit_or(F.call_function("shiftleft", one, F.col("_bit"))).alias("_bits")
    bitmap = wanted.select(*place).groupBy("_word").agg(marks)
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), F.col("_bit")).bitwiseAND(one) == 1
    return rows.select("*", *place).join(F.broadcast(bitmap), "_word").filter(hit).drop("_word", "_bit", "_bits")


class _Join:
    def __init__(self, df: DataFrame, words: int, num: int, den: int) -> None:
        self.df, self.words, self.num, self.den = df, words, num, den
        self.marked = stored(_marked(df, words, num, den), "marked")
        # Sent by doc_id, so that roots are the smallest ones; classes without any get a label above all of them.
        label = F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1) - F.pmod("class", F.lit(1 << 40)))
        self.classes = stored(self.marked.filter("n_shingles > 0").groupBy("class").agg(label.alias("label"), F.first("n_shingles").alias("n"), F.first("agreeing").alias("agreeing"), *(F.first(s).alias(s) for s in (*SKETCH, "wide"))), "classes")

    def near(self, a: str, b: str):
        return (F.col(a) * self.den >= F.col(b) * self.num) & (F.col(b) * self.den >= F.col(a) * self.num)

    def differences(self):
        """How many shingles a linked pair of sizes n_a and n_b may differ in."""
        both = self.num + self.den
        return F.expr(f"n_a + n_b - 2 * (({self.num} * (n_a + n_b) + {both - 1}) div {both})")

    def may_link(self):
        """Whether the sketches a and b differ in no more bits than linked sets of their sizes may."""
        bits = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SKETCH), F.lit(0))
        # The sizes of linked sets are so close that the longer sketch is at most twice as long as the other.
        folded = lambda x, y: F.when(F.size(x) == 2 * F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
        each = F.zip_with(folded("wide_a", "wide_b"), folded("wide_b", "wide_a"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        wide = F.aggregate(each, F.lit(0), lambda total, n: total + n)
        return (bits <= self.differences()) & (F.col("wide_a").isNull() | F.col("wide_b").isNull() | (wide <= self.differences()))

    def shares_enough(self):
        """Whether a pair is together in as many lists as a linked pair is."""
        agreeing = F.when(F.col("n_a") >= F.col("n_b"), F.col("agreeing_a")).otherwise(F.col("agreeing_b"))
        return F.col("lists") >= agreeing - self.differences()

    def members(self) -> DataFrame:
        """(key, class, n, first): lists with two classes or more, and their least class.

        No set is in its longest lists, nor in any of a level where it has fewer than a linked pair shares.
        """
        lists = self.marked.select(F.explode("keys").alias("key"), "class", F.col("n_shingles").alias("n"))
        ends = [F.min("class").alias("first"), F.max("class").alias("last"), F.count("*").alias("length")]

        def shared(rows: DataFrame) -> DataFrame:
            return stored(rows.groupBy("key").agg(*ends).filter("first <> last").drop("last"), "shared")

        both = shared(lists)
        # As many rows per class and level as a set has blocks.
        level = F.col("key").bitwiseAND(LIGHT).cast("int")
        own = Window.partitionBy("class", level)
        place = F.row_number().over(own.orderBy(F.desc("length"), F.desc("key")))
        left_out = F.element_at(F.array(*map(F.lit, Scheme(self.num, self.den).left_out())), level + 1)
        placed = among(lists, both, "key").join(both, "key").distinct().withColumns({"place": place, "lists": F.count("*").over(own)})
        # What a linked pair has in common besides the lists left out is more than these.
        kept = stored(placed.filter((F.col("place") > left_out) & (F.col("lists") > 2 * left_out)).select("key", "class", "n"), "kept")
        return stored(kept.join(shared(kept).drop("length"), "key"), "members")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored pairs (a, b) of classes that are linked, as labels."""
        needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        ids = stored(self.classes.select("class", "label").join(needed, "class"), "needed")
        rows = self._rows_of(ids.select(F.when(F.col("label") < NO_ID, F.col("label")).alias("id")))
        sets = stored(_sets(rows, self.words).groupBy("class").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")).join(ids, "class"), "sets")
        side = lambda x: sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "shingles", "label")))
        both = pairs.join(side("a"), F.col("a") == F.col("class_a")).join(side("b"), F.col("b") == F.col("class_b")).filter(self.near("n_a", "n_b"))
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        linked = both.filter(common * (self.den + self.num) >= self.num * (F.col("n_a") + F.col("n_b")))
        return stored(linked.select("a", "b", "label_a", "label_b"), "links")

    def _rows_of(self, ids: DataFrame) -> DataFrame:
        """The texts of rows with these ids, and of a few more; no text is shuffled."""
        source = self.df.select(F.col("doc_id").cast("long").alias("id"), "text")
        return among(source, ids, "id").select("text")

    def _sketched(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, lists) of classes that are likely linked, by their sizes, sketches and, for sets as large as a sketch, lists."""
        side = lambda x: self.classes.select(*(F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "agreeing", *SKETCH, "wide")))
        both = pairs.join(side("a"), F.col("a") == F.col("class_a")).join(side("b"), F.col("b") == F.col("class_b"))
        return both.filter(self.near("n_a", "n_b") & self.may_link() & (self.shares_enough() | (F.greatest("n_a", "n_b") <= 64 * SKETCH_LONGS))).select("a", "b")

    def _once(self, rest: DataFrame, lists: DataFrame) -> DataFrame:
        """Pairs (a, b, needed) of classes in different components that are likely linked, and how many lists they must share.

        A pair is named in the least of its common lists among the first of either class, not in each list that it shares;
        a pair that has none in common there is named in all of its lists, so that none is lost.
        """
        first = lists.select("class", F.slice("keys", 1, FIRST_LISTS).alias("first"))
        rows = stored(rest.join(self.classes.select("class", "agreeing", *SKETCH, "wide"), "class").join(first, "class"), "sketched")
        side = lambda x: rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "root", "agreeing", *SKETCH, "wide", "first")))
        here = F.col("key") == F.coalesce(F.array_min(F.array_intersect("first_a", "first_b")), F.col("key"))
        pairs = side("a").join(side("b"), "key").filter((F.col("root_a") > F.col("root_b")) & self.near("n_a", "n_b") & self.may_link() & here)
        needed = F.when(F.col("n_a") >= F.col("n_b"), F.col("agreeing_a")).otherwise(F.col("agreeing_b")) - self.differences()
        return pairs.select(F.greatest("class_a", "class_b").alias("a"), F.least("class_a", "class_b").alias("b"), needed.alias("needed"))

    def _in_enough(self, pairs: DataFrame, lists: DataFrame) -> DataFrame:
        """Those of the pairs that share as many lists as they must. Two classes of different components have all their common lists here."""
        side = lambda x: lists.select(F.col("class").alias(x), F.col("keys").alias(f"keys_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.filter(F.size(F.array_intersect("keys_a", "keys_b")) >= F.col("needed"))

    def roots(self, links: DataFrame) -> DataFrame:
        return components(links, "label_a", "label_b")

    def run(self) -> DataFrame:
        members = self.members()
        stars = members.filter("class <> first").groupBy(F.col("class").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("lists"))
        # A pair's other lists may have other least classes, so that it is left to the comparison below; none is lost.
        tested = stored(self._sketched(stored(stars, "stars")), "tested")
        links = self.links(tested)
        roots = stored(self.roots(links), "roots")
        placed = self._placed(roots)
        # Lists whose classes are not all in one component yet.
        now = stored(members.drop("first").join(placed, "class"), "placed")
        open_keys = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        rest = stored(now.join(stored(open_keys, "open"), "key"), "rest")
        lists = stored(rest.groupBy("class").agg(F.array_sort(F.collect_list("key")).alias("keys")), "lists")
        pairs = self._in_enough(stored(self._once(rest, lists).distinct(), "once"), lists)
        pairs = stored(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            more = self.links(pairs)
            if not more.isEmpty():
                placed = self._placed(stored(self.roots(links.union(more)), "roots"))
        found = stored(placed.select("class", F.when(F.col("root") < NO_ID, F.col("root")).alias("_component")), "found")
        out = self.marked.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class")).join(found, "class", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"))

    def _placed(self, roots: DataFrame) -> DataFrame:
        """(class, root) of all classes."""
        by_label = self.classes.select("class", "label").join(roots.withColumnRenamed("node", "label"), "label", "left")
        return by_label.select("class", F.coalesce("root", "label").alias("root"))


def jaccard_groups(df: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, for links at a Jaccard similarity of ``num/den`` or more. Runs jobs."""
    return _Join(df, words, num, den).run()


def one_of_each_group(df: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The rows of ``df`` without those that are near copies of one with a smaller doc_id. Runs jobs.

    Where rows share a doc_id or have none, all rows are written once more, numbered by doc_id (null last) and the hash of
    their text, and the numbers stand for ids. So a row goes only if one of its own group stays, and rows without words stay.
    """
    ids = df.groupBy(F.col("doc_id").cast("long").alias("_id")).count()
    rows, key, copy = df, "doc_id", unused(df, "_copy")
    if not ids.filter("count > 1 or _id is null").isEmpty():
        # Drawn, so that equal texts without id are dealt out.
        key, draw = unused(df, "_row"), unused(df, "_draw")
        drawn = stored(df.withColumn(draw, F.rand(7)), "drawn")
        rows = sorted_index(drawn, [F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64("text"), F.col(draw)], key)
    groups = stored(jaccard_groups(rows.select(F.col(key).alias("doc_id"), "text"), words, num, den), "groups")
    copies = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(copy))
    return rows.join(copies, rows[key].cast("long") == F.col(copy), "left_anti").select(*df.columns)
