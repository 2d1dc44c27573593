"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm.common import materialize, only_read, written
from folioscan.llm.decontaminate import drop_contaminated
from folioscan.llm.langid import keep_identified, train, training_sample
from folioscan.llm.minhash import one_of_each
from folioscan.llm.mixing import mix_sources
from folioscan.llm.secrets import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach; texts without a letter go."""
    return keep_identified(docs, train(training_sample(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, 0.8) keeps the document with the smallest id."""
    return one_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, up to a tenth of its characters edited."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets inside the texts; every document stays."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The reading order under weights that repeat no source more than four times."""
    return mix_sources(docs, max_repeats=4.0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("mixing", mixing)]

#: SQL expresses neither the language model nor the tagger: tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir; returns the rows of the last."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = only_read(materialize(stage(spark, docs, sf_dir), name), since)
    return docs
