"""Sharding, quality, toxicity, near copies and the pipeline against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import jaccard, quality, sharding, toxicity
from basketry.llm.components import components
from basketry.llm.queries import QUERIES
from tests.llm.conftest import documents
from tests.llm.test_tokens import check_packing

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def jump(key, shards):
    at, following = -1, 0
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def key_of(doc_id):
    return int(hashlib.md5(b"" if doc_id is None else str(doc_id).encode()).hexdigest()[:16], 16)


def check_shards(rows, docs, shards):
    want = Counter()
    for i, t in docs:
        text = (t or "").encode()
        want[i, len(text) + 16, zlib.crc32(text), jump(key_of(i), shards), jump(key_of(i), shards + 1)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, shards) for r in rows)


@pytest.mark.parametrize("shards", [1, 2, 40, 300])
def test_jump_hash(spark, shards):
    rows = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    check_shards(sharding.consistent_shards(rows, shards).collect(), [(n, "x") for n in range(3000)], shards)


@pytest.mark.parametrize("source", ["awkward", "empty"])
def test_shards_of_awkward_tables(source, request):
    df = request.getfixturevalue(source)
    check_shards(sharding.consistent_shards(df, 40).collect(), [(r.doc_id, r.text) for r in df.collect()], 40)


def base(text):
    words = SPACE.findall(text or "")
    places = defaultdict(list)
    for n in range(len(words) - 4):
        places[tuple(words[n : n + 5])].append(n)
    covered = {m for found in places.values() if len(found) > 1 for n in found for m in range(n, n + 5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def check_quality(rows, docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *base(t)) for i, t in docs)
    for r in rows:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


@pytest.mark.parametrize("source", ["awkward", "empty"])
def test_quality_of_awkward_tables(source, request):
    df = request.getfixturevalue(source)
    check_quality(quality.judged(df, quality.Limits(0.18, 0.5)).collect(), [(r.doc_id, r.text) for r in df.collect()])
    kept = quality.keep_good(df, quality.Limits(0.18, 0.5))
    assert kept.schema == df.schema
    kept.collect()


def test_quality_query(spark, sf):
    rows = QUERIES["op10_quality_rules"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_quality(rows, docs.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.n_words >= 30]
    assert np.mean([k == (q == 1) for k, q in judged]) > 0.95


def test_distances_tell_shouting_and_symbols_from_prose(spark):
    rng = random.Random(4)
    words = ["the", "of", "and", "house", "river", "small", "green", "walks", "over", "a"] + [f"w{chr(97 + n)}ord" for n in range(26)]
    prose = [" ".join(rng.choice(words) for _ in range(80)) + "." for _ in range(60)]
    odd = [p.upper().replace(" ", "!! ") for p in prose[:3]] + [p.replace(" ", " | ") for p in prose[3:6]] + [p.replace(" ", "### ") for p in prose[6:9]]
    rows = quality.judged(documents(spark, prose + odd), quality.Limits(0.18, 0.5)).collect()
    assert {r.doc_id for r in rows if r.class_distance > 0.18} == set(range(60, 69))


def spoken(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(12)]
    return [" ".join(rng.choice(words) for _ in range(80)) + "." for _ in range(n)]


def test_every_language_has_its_own_reference(spark):
    """Seventy small languages in Cyrillic beside a large one in Latin, and clean texts without language."""
    rng = random.Random(8)
    rows = [("en", t) for t in spoken(rng, "abcdefghiklmnorstu", 300)]
    for n in range(70):
        rows += [(f"x{n}", t) for t in spoken(rng, "абвгдежзиклмнопрсту", 4)]
    rows += [(lang, t) for lang in (None, "") for t in spoken(rng, "абвгдежзиклмнопрсту", 4)]
    rows += [("en", t) for t in spoken(rng, "абвгдежзиклмнопрсту", 3)]
    docs = spark.createDataFrame([(n, t, lang) for n, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    limits = quality.Limits(0.18, 0.75)
    got = {r.doc_id: r for r in quality.judged(docs, limits).collect()}
    want = {n for n in range(len(rows) - 3) if not got[n].base_failed}
    assert len(want) > 500 and {n for n, r in got.items() if r.kept} == want
    assert {n for n, r in got.items() if r.class_distance is None} == {n for n, (lang, _) in enumerate(rows) if not lang}
    assert {r.doc_id for r in quality.keep_good(docs, limits).collect()} == want


def test_words_are_counted_exactly_in_any_layout(spark):
    """More than a thousand different words, each rare in every batch."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(400)) for _ in range(60)] + ["Über über ÜBER it's", None, ""]
    want = Counter(w for t in texts for w in re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    docs = documents(spark, texts)
    found = []
    for parts in (1, 7):
        counts = quality.reference_counts(docs.repartition(parts)).collect()
        assert {r.name: r.total for r in counts if r.kind == "word"} == want
        assert [r.total for r in counts if r.kind == "size"] == [want.total()]
        found.append([tuple(r) for r in quality.references(docs.repartition(parts)).collect()])
    assert found[0] == found[1] and len(found[0]) == 1
    _, hashes, shares = quality._unpacked(bytes(found[0][0][1]))
    assert sorted(shares[:-1]) == sorted(n / want.total() for _, n in want.most_common(64)) and len(hashes) == 64


def plain_groups(docs, words, num, den):
    sets = []
    for _, text in docs:
        found = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(found)} if 0 < len(found) < words else {tuple(found[n : n + words]) for n in range(len(found) - words + 1)})
    parent = list(range(len(docs)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(docs):
        if sets[n] and i is not None:
            least[root(n)].append(i)
    return Counter((i, len(sets[n]), i if not sets[n] else min(least[root(n)], default=None)) for n, (i, _) in enumerate(docs))


def near_copies(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = [rng.choice("abcdefghijkl") + str(rng.randint(0, 30)) for _ in range(rng.choice([1, 2, 3, 9, 11, 12, 13, 19, 20, 21, 22, 23, 25, 30, 45, 60, 150]))]
        for _ in range(rng.randint(1, 7)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(own))
                kind = rng.random()
                if kind < 0.4:
                    own[at] = f"z{rng.randint(0, 99)}"
                elif kind < 0.7 and len(own) > 1:
                    del own[at]
                else:
                    own.insert(at, "Y")
            texts.append(" ".join(own))
    return texts + [None, "", " \n"]


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 80, 100), (1, 80, 100), (2, 60, 100)])
def test_groups_equal_brute_force(spark, words, num, den):
    texts = near_copies(words)
    got = jaccard.jaccard_groups(documents(spark, texts), words, num, den).collect()
    assert Counter(tuple(r) for r in got) == plain_groups(list(enumerate(texts)), words, num, den)


@pytest.mark.parametrize("source", ["awkward", "empty"])
def test_groups_of_awkward_tables(source, request):
    df = request.getfixturevalue(source)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = jaccard.jaccard_groups(df, 3, 90, 100).collect()
    assert Counter(tuple(r) for r in got) == plain_groups(docs, 3, 90, 100)
    kept = jaccard.one_of_each_group(df, 5, 80, 100)
    assert kept.schema == df.schema
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({r.doc_id for r in got if r.doc_id is not None and r.component_id in (None, r.doc_id)})


def test_rows_that_share_an_id_go_only_as_copies(spark):
    """Ids numbered per source, and rows without id."""
    text = lambda n: " ".join(f"w{n}x{m}" for m in range(40))
    rows = [(1, text(0)), (7, text(0)), (7, text(1)), (7, text(2)), (7, text(2) + " more"), (9, text(3)), (None, text(3)), (None, text(4)), (None, text(4)), (5, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = jaccard.one_of_each_group(docs, 5, 80, 100)
    assert kept.schema == docs.schema
    found = Counter((r.doc_id, (r.text or "").replace(" more", "")) for r in kept.collect())
    assert found == Counter([(1, text(0)), (7, text(1)), (7, text(2)), (9, text(3)), (None, text(4)), (5, ""), (5, "")])


def test_one_large_group_of_near_copies(spark):
    words = [f"w{n}" for n in range(200)]
    texts = [" ".join([*words[: n % 190], f"own{n}", *words[n % 190 :]]) for n in range(400)]
    rows = jaccard.jaccard_groups(documents(spark, texts), 3, 90, 100).collect()
    assert {r.component_id for r in rows} == {0}


def test_components_of_chains_and_stars(spark):
    links = [(n, n + 1) for n in range(0, 60)] + [(100, 100 + n) for n in range(1, 40)] + [(205, 203), (203, 209), (7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 203: 203, 205: 203, 209: 203}


def test_jaccard_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op2_jaccard_groups"](spark, sf).collect()) == plain_groups(docs, 3, 90, 100)


def labelled(spark, seed, bad=("nasty", "vile", "gronkig", "gronkal", "gronko")):
    rng = random.Random(seed)
    texts, marks = [], []
    for n in range(600):
        words = [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randint(0, 20)) for _ in range(rng.randint(5, 60))]
        mark = n % 6 == 0
        for _ in range(rng.randint(1, 3) if mark else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        marks.append((n, int(mark)))
    return documents(spark, texts), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_learns_words_and_beginnings(spark):
    docs, labels = labelled(spark, 5)
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 1"))
    assert {"nasty", "vile"} <= set(model.voters) and any(v.startswith("gronk") for v in model.voters)
    joined = toxicity.score(docs, model).join(labels, "doc_id").filter("doc_id % 3 = 1").collect()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in joined]) > 0.97
    unseen = toxicity.score(documents(spark, ["ba re lo gronkest ti", "ba re lo ti"]), model).collect()
    scores = {r.doc_id: r.score for r in unseen}
    assert scores[0] > scores[1]


def test_label_model_recovers_posteriors():
    """Two independent voters, and one voter in five copies that must not count five times."""
    rng = np.random.default_rng(6)
    truth = rng.random(4000) < 0.2
    fires = lambda hit, miss: np.where(truth, rng.random(4000) < hit, rng.random(4000) < miss)
    copied = fires(0.5, 0.2)
    votes = np.column_stack([fires(0.6, 0.01), fires(0.5, 0.02), *[copied] * 5]).astype(np.uint8)
    noisy = np.where(rng.random(4000) < 0.05, ~truth, truth).astype(int)
    model, posterior = toxicity.fit_label_model(votes, noisy)
    assert model.weight[2:7].max() < 0.25 < model.weight[0]
    assert ((posterior > 0.5) == truth).mean() > 0.95


@pytest.mark.parametrize("source", ["awkward", "empty"])
def test_toxicity_of_awkward_tables(spark, source, request):
    df = request.getfixturevalue(source)
    _, labels = labelled(spark, 7)
    for marks in (labels, labels.limit(0), labels.filter("toxic = 1"), spark.createDataFrame([(None, 1), (3, None), (3, 1), (3, 1)], labels.schema)):
        model = toxicity.fit(df, marks)
        rows = toxicity.score(df, model).collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.keep_below(df, model, 0.7).schema == df.schema


def test_toxicity_query(spark):
    rows = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == t for p, t in held]) > 0.9


def test_pipeline_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in QUERIES["op10_quality_rules"](spark, sf).collect() if r.kept}
    now = corpus_pipeline.good_documents(spark, docs, sf)
    assert now.schema == docs.schema and {r.doc_id for r in now.collect()} == kept
    now = docs.filter(F.col("doc_id").isin(list(kept)))
    harmless = corpus_pipeline.harmless_documents(spark, now, sf)
    ids = {r.doc_id for r in harmless.collect()}
    assert harmless.schema == docs.schema and ids <= kept
    groups = plain_groups([(i, texts[i]) for i in sorted(ids)], 5, 80, 100)
    left = {i for i, _, component in groups if component == i}
    distinct = corpus_pipeline.distinct_documents(spark, docs.filter(F.col("doc_id").isin(list(ids))), sf)
    assert distinct.schema == docs.schema and {r.doc_id for r in distinct.collect()} == left
    from tokenizers import Tokenizer

    import public_tokenizers

    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, sf).collect()
    check_packing(rows, [(i, words.encode(texts[i], add_special_tokens=False).ids + [0]) for i in left], 2048)


@pytest.mark.parametrize("key", ["op2_jaccard_groups", "op4_threshold_top_k", "op7_consistent_shards"])
def test_queries_equal_their_sql(spark, sf, key):
    from basketry.llm.queries import ORACLES
    from tests.compare import compare, database

    ok, text, _, _ = compare(spark, sf, QUERIES[key], ORACLES[key], database(sf))
    assert ok, text


def test_long_texts_that_share_a_passage_are_told_by_sketches(spark, monkeypatch):
    """500 unlinked texts of 3,000 words with a common passage, and near copies of a few of them."""
    import numpy as np

    from basketry.llm import jaccard

    draw = np.random.default_rng(8)
    passage = [f"p{n}" for n in range(1500)]
    texts = [" ".join(passage + [f"w{n}" for n in draw.integers(0, 10**9, 1500)]) for _ in range(500)]
    near = [" ".join([*texts[n].split()[:2990], *"changed at the very end".split()]) for n in (3, 77, 499)]
    rows = spark.createDataFrame(list(enumerate([*texts, *near])), "doc_id long, text string").repartition(8)
    seen = []
    links = jaccard._Join.links
    monkeypatch.setattr(jaccard._Join, "links", lambda self, pairs: seen.append(pairs.count()) or links(self, pairs))
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(rows, 3, 90, 100).collect()}
    assert found == {**{n: n for n in range(500)}, 500: 3, 501: 77, 502: 499}
    # Next to no other pair is compared on whole sets.
    assert sum(seen) < 50


def test_sketches_of_linked_sets_never_differ_too_much():
    import numpy as np

    from basketry.llm import jaccard

    draw = np.random.default_rng(4)
    scheme = jaccard.Scheme(90, 100)
    for n in (100, 2400, 9000):
        a = np.unique(draw.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.concatenate([a[: -n // 25], draw.integers(0, 1 << 60, n // 25).astype(np.uint64)])
        c = draw.integers(0, 1 << 60, n).astype(np.uint64)
        wide = [jaccard.long_sketches(scheme, s, np.array([len(s)]))[0] for s in (a, b, c)]
        if wide[0] is None:
            assert n == 100
            continue
        bits = lambda x, y: int(sum(int(p ^ q).bit_count() for p, q in zip(x.view(np.uint64).tolist(), y.view(np.uint64).tolist())))
        assert bits(wide[0], wide[1]) <= 2 * (n // 25) <= scheme.differences(n) < bits(wide[0], wide[2])
        half = wide[0].reshape(2, -1)
        assert (half[0] ^ half[1] == jaccard.sketches(a, np.array([len(a)]), len(half[0]))[0]).all()


AWKWARD_NAMES = ["_id", "_lang", "_reference", "_copy", "_row", "_p", "_band", "_draw", "_before"]


def test_any_column_name_passes_through_the_stages(spark):
    from basketry.llm.jaccard import one_of_each_group
    from basketry.llm.quality import Limits, keep_good

    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, text), (2, text), (2, "other words " + text), (None, text), (None, text + " more"), (5, "")]
    values = [100 * n for n in range(len(rows))]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} long" for c in AWKWARD_NAMES)
    df = spark.createDataFrame([(i, t, "en", *[v + k for k in range(len(AWKWARD_NAMES))]) for (i, t), v in zip(rows, values)], schema)
    before = {tuple(r) for r in df.collect()}
    for kept in (one_of_each_group(df, 5, 80, 100), keep_good(df, Limits(2.0, 2.0)), one_of_each_group(df.filter("doc_id in (1, 5)"), 5, 80, 100)):
        assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= before
    assert one_of_each_group(df, 5, 80, 100).count() == 2 and keep_good(df, Limits(2.0, 2.0)).count() == 5


def test_a_pair_of_many_common_lists_is_named_once(spark, monkeypatch):
    """Texts that are nearly linked share many lists; all pairs and groups are those of a plain comparison."""
    texts = []
    for n in range(24):
        words = [f"w{m}" for m in range(400)]
        # Two texts with three changes each are linked, one with three and one with four changes are not quite.
        for change in range(3 + n % 2):
            words[4 * (4 * n + change) + 2] = f"own{n}x{change}"
        texts.append(" ".join(words))
    seen = []
    once = jaccard._Join._once

    def watched(self, rest, lists):
        pairs = once(self, rest, lists)
        seen.append((pairs.count(), {(r.a, r.b) for r in pairs.collect()}, lists.agg(F.min(F.size("keys"))).first()[0]))
        return pairs

    monkeypatch.setattr(jaccard._Join, "_once", watched)
    got = jaccard.jaccard_groups(documents(spark, texts), 3, 90, 100).collect()
    assert Counter(tuple(r) for r in got) == plain_groups(list(enumerate(texts)), 3, 90, 100)
    [(rows, pairs, lists)] = seen
    assert len(pairs) > 50 and lists > 16 and rows <= 1.1 * len(pairs)
