"""The queries of this subpackage with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import oracles, pu_quality, toxicity, url_filter
from basketry.llm.byte_bpe import round_trip
from basketry.llm.common import crc32_remainder, table
from basketry.llm.jaccard import jaccard_groups
from basketry.llm.lexical import ranked_search
from basketry.llm.packing import pack_documents
from basketry.llm.quality import Limits, judged
from basketry.llm.sharding import consistent_shards
from basketry.llm.token_counts import token_counts
from basketry.llm.token_files import read_token_files, write_documents
from basketry.llm.topk import exact_top_k
from basketry.llm.whitening import whitened
from basketry.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


@query("op7_consistent_shards", oracles.consistent_shards(40))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = consistent_shards(table(spark, sf_dir, "documents"), 40)
    return shards.withColumn("law", F.lit("key"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, path=path)
    return read_token_files(spark, path)


QUALITY = Limits(max_class=0.18, max_word=0.5)


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), QUALITY)


@query("op2_jaccard_groups", oracles.jaccard_groups(3, 90, 100))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


TOXIC_FROM = 0.7


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc32_remainder("doc_id", 3) == 1
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").filter(~held_out))
    scores = toxicity.score(documents, model)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query("op4_threshold_top_k", oracles.top_k(5, 50))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES)


GOOD_FROM = 0.3


@query("op11_pu_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc32_remainder("doc_id", 5) == 0
    known = table(spark, sf_dir, "labels").filter(~held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    model = pu_quality.fit(documents, known.filter("quality = 1"))
    scores = pu_quality.score(documents, model)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), components=8)


@query("op13_ranked_search", oracles.ranked_search(10))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
