"""A corpus from raw documents to packed batches.

Stages: language identification (documents without a determined language go),
toxicity (documents scored as toxic go), n-gram Jaccard join (one document of
each group of near copies stays), packing (length buckets and batches).

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``docs``. A stage treats nulls, empty texts, repeated rows and empty tables
as its operator states.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

import loomframe  # noqa: E402
from loomframe.llm import jaccard_join, language_id, length_buckets, toxicity  # noqa: E402
from loomframe.llm.common import Scratch  # noqa: E402

# functions and classes of this package travel to the executors by value
cloudpickle.register_pickle_by_value(loomframe)

#: A clean text in one language scores near 1, so only undetermined and thoroughly mixed texts fall below.
MIN_LANGUAGE_SCORE = 0.25
TOXIC_FROM = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined."""
    model = language_id.fit_languages(docs, "doc_id", "text", "lang")
    return language_id.keep_identified(docs, model, MIN_LANGUAGE_SCORE)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on the labels table, scores as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels), TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: shingles of five words, similarity 0.8."""
    return jaccard_join.keep_one_of_each(docs, jaccard_join.jaccard_components(docs, words=5, percent=80))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into length buckets and batches of a token budget."""
    lengths = docs.select("doc_id", length_buckets.word_count("text").alias("n_tokens"))
    return length_buckets.pack(lengths, "doc_id", "n_tokens", buckets=16, budget=32_768)


STAGES = [("language", language), ("toxicity", non_toxic), ("near_duplicates", near_duplicates), ("packing", packing)]

#: The classifiers, the join's components and the bucket bounds have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
