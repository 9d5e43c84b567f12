"""A training corpus from ``documents``: quality, language, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import language, packing, quality, simhash, substrings
from leafmill.llm.common import joined, table, unused

#: Not all stages can be said in SQL: tests/llm holds ``run`` against a version over lists.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1. A score depends on the text alone, so texts are what is rejected."""
    (node,) = unused(docs, "_node")
    keyed = docs.withColumn(node, simhash.node_of("text"))
    found = quality.scored(keyed, table(spark, sf_dir, "labels"), carry=(node,))
    return joined(keyed, found.where("predicted = 0").select(node).distinct(), [node], "left_anti").drop(node)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the evidence agrees on. It depends on text, declaration and source: these are what is rejected."""
    (key,) = unused(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(simhash.node_of("text"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))))
    rows = keyed.select(key, "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))
    found = language.identified(rows, carry=(key,))
    return joined(keyed, found.where("not kept").select(key).distinct(), [key], "left_anti").drop(key)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints within 2 bits, as in op1, or a similarity of 0.8 or more of five-word shingles."""
    return simhash.without_copies(docs, radius=2)


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return substrings.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", good), ("language", identified), ("near copies", single), ("repeated passages", cut), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
