"""Stages that make a training corpus out of ``documents``.

Quality rules and toxicity reject documents, near copies leave one document of each group, and what is left is packed into
sequences. Every stage but the last returns documents with all their columns; the last returns the pieces and their places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basketry.llm.common import crc32_remainder, small_batches, stored, table
from basketry.llm.jaccard import one_of_each_group
from basketry.llm.packing import pack_documents
from basketry.llm.quality import keep_good
from basketry.llm.queries import QUALITY, TOXIC_FROM
from basketry.llm.toxicity import fit, keep_below


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_good(docs, QUALITY)


def harmless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(crc32_remainder("doc_id", 3) != 1)
    return keep_below(docs, fit(docs, labels), TOXIC_FROM)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 % of their five-word shingles or more."""
    small_batches(spark)
    return one_of_each_group(docs, words=5, num=80, den=100)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_rules", good_documents),
    ("toxicity", harmless_documents),
    ("near_duplicates", distinct_documents),
    ("packing", packed_documents),
]
# Trained scores and vocabularies are beyond SQL; tests compare the pipeline with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
