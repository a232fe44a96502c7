"""Corpus pipeline: five operators in a row over the documents table.

Every stage takes what the one before has kept; each but the last returns the
columns of ``documents``.  ``run`` writes each stage's rows under the shared
checkpoint folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from aerogrid.llm import bpe, decontaminate, language_id, quality, simhash
from aerogrid.llm.common import land
from aerogrid.llm.queries import quality_model, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as low quality go."""
    return quality.keep_good(docs, quality_model(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one_per_group(docs, shingle_words=3, max_bits=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), window=10)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded again."""
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("quality", classify_quality), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_benchmark_leaks), ("bpe", tokenize)]

#: The language and quality models and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
