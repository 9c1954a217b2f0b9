"""A corpus pipeline of five stages, each by one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import decontaminate, language_id, minhash_dedup, secret_scan, sentencepiece_codec
from leafloom.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go, and those surely in another language than they say."""
    return language_id.known_language(docs, language_id.train(docs))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return minhash_dedup.one_of_each(docs, length=5, percent=80)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    return secret_scan.redact(docs, *secret_scan.fitted(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    coded = sentencepiece_codec.encoded(docs, sentencepiece_codec.load(), back="__back")
    coded = coded.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))
    return coded.withColumn("round_trip", F.col("__back").eqNullSafe(F.col("text"))).select("doc_id", "lang", "source", "n_pieces", "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", remove_near_copies),
    ("benchmark_decontamination", remove_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]

#: Learned models take part in the first, fourth and fifth stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
