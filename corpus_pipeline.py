"""A corpus pipeline over ``documents``: language, near duplicates, benchmark passages, secrets, packing.

Every stage reads all rows that its predecessor kept and is written as Parquet
before the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costwise.llm import decontaminate, langid, ngram_join, packing, secret_scan
from costwise.llm.storage import scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the classifier is sure of, go."""
    return langid.keep_identified(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by n-gram overlap, near copies among them, the smallest id stays.

    Four words and 85 % are the contract of the query op3 alone; near copies share 80 % of their five-word shingles."""
    return ngram_join.one_of_each(docs, ngram_join.Params(words=5, percent=80))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in it are replaced, and n_chars follows its text."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("secret_scan", remove_secrets),
    ("packing", pack_sequences),
]

#: Language ID is a fitted classifier and packing counts a tokenizer's ids: no SQL states the rows.
#: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
