"""Quality rules: repetition and length first, then the distance of a document's histograms from its language's.

Every language's reference is gathered from all documents: for each character class the median of its share in documents
of ``LEAST_WORDS`` words or more, so that junk does not move it, and the shares of the language's most common words and of
all the rest. A document is compared with the reference of its language by Jensen-Shannon distance (base 2, 0 to 1).
Documents under ``min_words`` words are not judged by distance: short texts are far from any reference by chance.

Every word is counted, so references do not depend on how the rows are dealt into files and batches. They are a table joined by language, which Spark broadcasts while
it is small, so there may be any number of languages.

Defined results: null and empty texts have zero in every count, fail the base rules and are not kept; documents whose
language is null or empty have no reference, so the base rules alone decide and their distances are null; rows are judged one
by one, so repeated rows repeat their verdict; words equally common are taken in text order; an empty table gives an empty
table; further columns are kept by ``keep_good`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import IS_SPACE, LOWER, NO_LETTER, U64, Hasher, mix, slices, stored, word_bounds
from basketry.runtime import unused

COMMON_WORDS = 64
LEAST_WORDS = 30
# Distinct words, and bytes of them, that a task counts before it hands the counts on.
HELD_WORDS, HELD_BYTES = 100_000, 1 << 24
# Steps of the square root of a share, in which medians are found.
BINS = 250
WINDOW = 5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LINE_END = np.zeros(256, bool)
LINE_END[10] = True
# Classes: 0 inside of a character, 1 a-z, 2 A-Z, 3 digit, 4 white space, 5 full stop and comma, 6 other marks of prose, 7 other
# ASCII marks, 8 beyond ASCII, 9 control.
CLASS = np.full(256, 7, np.int64)
CLASS[:32], CLASS[127] = 9, 9
CLASS[IS_SPACE] = 4
CLASS[list(b".,")] = 5
CLASS[list(b";:!?'\"()-")] = 6
CLASS[48:58], CLASS[65:91], CLASS[97:123] = 3, 2, 1
CLASS[128:192], CLASS[192:] = 0, 8
CLASSES = 10


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(key: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs twice or more."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    texts = len(offsets) - 1
    hasher.prepare(data)
    starts, ends, owner = word_bounds(data, offsets)
    in_words = ~IS_SPACE[data]
    out = {
        "n_words": np.bincount(owner, minlength=texts),
        "word_chars": _per_text(in_words & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(SYMBOL[data], offsets),
    }
    line_starts, line_ends, line_owner = word_bounds(data, offsets, LINE_END)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_words, out=sums[1:])
    full = sums[line_ends] > sums[line_starts]
    line_owner = line_owner[full]
    lines = hasher.spans(line_starts[full], line_ends[full]) ^ mix(line_owner.astype(np.uint64))
    _, first = np.unique(lines, return_index=True)
    out["n_dup_lines"] = np.bincount(line_owner, minlength=texts) - np.bincount(line_owner[first], minlength=texts)
    repeats = np.zeros(texts, np.int64)
    if len(starts) >= WINDOW:
        words = hasher.spans(starts, ends)
        whole = owner[: 1 - WINDOW] == owner[WINDOW - 1 :]
        key = mix(owner[: 1 - WINDOW].astype(np.uint64))
        for n in range(WINDOW):
            key = mix(key * U64(0x9E3779B97F4A7C15) + words[n : len(words) - WINDOW + 1 + n])
        at = np.flatnonzero(whole)
        at = at[_again(key[at])]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        repeats = np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=texts)
    out["n_repeat_words"] = repeats
    return out


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    counts = np.bincount(owner * CLASSES + CLASS[data], minlength=texts * CLASSES).reshape(texts, CLASSES)
    counts[:, 0] = 0
    return counts


def _prose_words(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Hashes, owners, starts and ends of the words in lower case."""
    lowered = LOWER[data]
    hasher.prepare(lowered)
    starts, ends, owner = word_bounds(lowered, offsets, NO_LETTER)
    return hasher.spans(starts, ends), owner, starts, ends, lowered


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def reference_counts(df: DataFrame) -> DataFrame:
    """(lang, kind, name, total) over all documents with a language.

    Kind ``class`` counts documents by class and step of its share, named ``class * (BINS + 1) + step``; kind ``word`` counts
    each word, and kind ``size`` all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, totals, held = Hasher(), {}, 0
        for batch in batches:
            langs = np.array(_column(batch, "lang"), object)
            for first, end, data, offsets in slices(batch):
                names, group = np.unique(langs[first:end], return_inverse=True)
                counts = class_counts(data, offsets)
                words, owner, starts, ends, lowered = _prose_words(data, offsets, hasher)
                steps = (np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))) * BINS).round().astype(np.int64)
                long = np.bincount(owner, minlength=end - first) >= LEAST_WORDS
                # Words by language, and there by hash.
                order = np.lexsort((words, group[owner]))
                edges = np.cumsum(np.append(0, np.bincount(group[owner], minlength=len(names))))
                whole = lowered.tobytes()
                for n, lang in enumerate(names):
                    cells = np.bincount((steps + np.arange(CLASSES) * (BINS + 1))[(group == n) & long].ravel())
                    for cell in np.flatnonzero(cells).tolist():
                        key = lang, "class", str(cell).encode()
                        totals[key] = totals.get(key, 0) + int(cells[cell])
                    mine = order[edges[n] : edges[n + 1]]
                    key = lang, "size", b""
                    totals[key] = totals.get(key, 0) + len(mine)
                    new = np.flatnonzero(np.append(True, words[mine[1:]] != words[mine[:-1]])[: len(mine)])
                    number = np.diff(np.append(new, len(mine)))
                    at = mine[new]
                    for begin, stop, times in zip(starts[at].tolist(), ends[at].tolist(), number.tolist()):
                        key = lang, "word", whole[begin:stop]
                        if key in totals:
                            totals[key] += times
                        else:
                            totals[key] = times
                            held += stop - begin
                if len(totals) > HELD_WORDS or held > HELD_BYTES:
                    yield _rows(totals)
                    totals, held = {}, 0
        yield _rows(totals)

    def _rows(totals: dict) -> pa.RecordBatch:
        langs, kinds, names = zip(*totals) if totals else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(kinds, pa.string()), pa.array([x.decode(errors="replace") for x in names], pa.string()), pa.array(totals.values(), pa.int64())],
            ["lang", "kind", "name", "total"],
        )

    spoken = df.select(df["lang"].cast("string").alias("lang"), "text").filter("lang <> ''")
    counted = spoken.mapInArrow(run, "lang string, kind string, name string, total long")
    return counted.groupBy("lang", "kind", "name").agg(F.sum("total").alias("total"))


def _reference(group: pa.Table) -> pa.Table:
    """One language's row: the shares of its classes, the hashes of its common words in order, and their shares and the rest's."""
    cells, words, size = np.zeros((CLASSES, BINS + 1)), {}, 0
    for kind, name, total in zip(*(group.column(c).to_pylist() for c in ("kind", "name", "total"))):
        if kind == "class":
            cells[divmod(int(name), BINS + 1)] = total
        elif kind == "word":
            words[name] = total
        else:
            size = total
    table = np.cumsum(cells, axis=1)
    classes = ((table < table[:, -1:] / 2).sum(axis=1) / BINS) ** 2
    names, hasher = sorted(words), Hasher()
    ends = np.cumsum([0, *(len(w.encode()) for w in names)]).astype(np.int64)
    hasher.prepare(np.frombuffer("".join(names).encode(), np.uint8))
    hashes = hasher.spans(ends[:-1], ends[1:])
    order = np.argsort(hashes)
    shares = np.array([words[names[i]] / max(1, size) for i in order])
    packed = (classes / max(classes.sum(), 1e-9)).tobytes() + hashes[order].tobytes() + np.append(shares, max(0.0, 1 - shares.sum())).tobytes()
    return pa.table({"_lang": pa.array(group.column("lang").to_pylist()[:1], pa.string()), "_reference": pa.array([packed], pa.binary())})


def _unpacked(reference: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = (len(reference) // 8 - CLASSES - 1) // 2
    numbers = np.frombuffer(reference, np.float64)
    return numbers[:CLASSES], np.frombuffer(reference, np.uint64, words, 8 * CLASSES), numbers[CLASSES + words :]


def references(df: DataFrame) -> DataFrame:
    """(_lang, _reference) of every language, see ``_reference``; stored. Runs jobs."""
    counts = stored(reference_counts(df), "quality-counts")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "name"))
    common = counts.filter("kind = 'word'").withColumn("place", place).filter(F.col("place") <= COMMON_WORDS).drop("place")
    # At most CLASSES * (BINS + 1) + COMMON_WORDS + 1 rows of a language.
    rows = counts.filter("kind <> 'word'").unionByName(common)
    return stored(rows.groupBy("lang").applyInArrow(_reference, "_lang string, _reference binary"), "quality-references")


def with_references(df: DataFrame, name: str = "_reference") -> DataFrame:
    """``df`` with the reference of its language as column ``name``, null where there is none. Runs jobs."""
    lang = unused(df, "_lang")
    return df.join(references(df).toDF(lang, name), df["lang"].cast("string") == F.col(lang), "left").drop(lang)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from ``q``; rows of zeros have distance 0."""
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / middle), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / middle), 0).sum(axis=-1)
    return np.where(p.sum(axis=-1) > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = {**dict.fromkeys(COUNTS, "long"), "class_distance": "double", "word_distance": "double", "n_common": "long"}


class Measurer:
    """Measures of slices of texts against the reference of each; distances are NaN where that is null."""

    def __init__(self) -> None:
        self.hasher = Hasher()

    def measure(self, references: list[bytes | None], data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        texts = len(references)
        out = base_counts(data, offsets, self.hasher)
        classes = class_counts(data, offsets)
        words, owner, *_ = _prose_words(data, offsets, self.hasher)
        out |= {"class_distance": np.full(texts, np.nan), "word_distance": np.full(texts, np.nan), "n_common": np.zeros(texts, np.int64)}
        groups: dict = {}
        for n, reference in enumerate(references):
            groups.setdefault(reference, []).append(n)
        group, within = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for n, mine in enumerate(groups.values()):
            group[mine], within[mine] = n, np.arange(len(mine))
        # Words by group, so that each language looks at its own only.
        by_group = np.argsort(group[owner], kind="stable")
        ends = np.cumsum(np.bincount(group[owner], minlength=len(groups)))
        for n, (packed, mine) in enumerate(groups.items()):
            if packed is None:
                continue
            reference, hashes, shares = _unpacked(packed)
            amount = classes[mine] / np.maximum(1, classes[mine].sum(axis=1, keepdims=True))
            out["class_distance"][mine] = js_distance(amount, reference)
            width = len(hashes) + 1
            at = by_group[ends[n - 1] if n else 0 : ends[n]]
            own = words[at]
            place = np.minimum(np.searchsorted(hashes, own), max(0, width - 2))
            place = np.where(hashes[place] == own, place, width - 1) if width > 1 else np.zeros(len(own), np.int64)
            table = np.bincount(within[owner[at]] * width + place, minlength=len(mine) * width).reshape(-1, width)
            out["n_common"][mine] = table[:, :-1].sum(axis=1)
            out["word_distance"][mine] = js_distance(table / np.maximum(1, table.sum(axis=1, keepdims=True)), shares)
        return out


@dataclass(frozen=True)
class Limits:
    """From which distances on a text of ``min_words`` words or more is rejected."""

    max_class: float
    max_word: float
    min_words: int = LEAST_WORDS

    def judge(self, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text fails the base rules, and whether it is kept."""
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        far = (m["n_words"] >= self.min_words) & ((m["class_distance"] > self.max_class) | (m["word_distance"] > self.max_word))
        return failed, ~failed & ~far


def judged(df: DataFrame, limits: Limits, id_column: str = "doc_id") -> DataFrame:
    """(id, base counts, distances, base_failed, kept) of every whole text. Runs jobs for the references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer()
        for batch in batches:
            known = _column(batch, "_reference")
            for first, end, data, offsets in slices(batch):
                measured = measurer.measure(known[first:end], data, offsets)
                failed, kept = limits.judge(measured)
                values = [pa.array(measured[n].astype(np.float64 if kind == "double" else np.int64), from_pandas=True) for n, kind in MEASURES.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *values, pa.array(failed), pa.array(kept)], names)

    names = ["id", *MEASURES, "base_failed", "kept"]
    rows = with_references(df.select(df[id_column].alias("id"), "lang", "text")).drop("lang")
    schema = ", ".join([f"id {df.schema[id_column].dataType.simpleString()}", *(f"{n} {k}" for n, k in MEASURES.items()), "base_failed boolean", "kept boolean"])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def keep_good(df: DataFrame, limits: Limits) -> DataFrame:
    """The rows of ``df`` whose text is kept, with all their columns. Runs jobs for the references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer()
        for batch in batches:
            known = _column(batch, name)
            batch = batch.select(columns)
            for first, end, data, offsets in slices(batch):
                _, kept = limits.judge(measurer.measure(known[first:end], data, offsets))
                yield batch.slice(first, end - first).filter(pa.array(kept))

    columns, name = df.columns, unused(df, "_reference")
    return with_references(df, name).mapInArrow(run, df.schema)
