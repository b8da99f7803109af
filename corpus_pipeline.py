"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import Stash, read
from corpusmill.llm.packing import pack_documents
from corpusmill.llm.quality_classifier import keep_likely
from corpusmill.llm.quality_rules import keep_good
from corpusmill.llm.secrets import redact_secrets
from corpusmill.llm.simhash import keep_one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, rejects go."""
    return keep_likely(docs, read(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing and repeated lines go, and documents that the rules reject."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: A fitted network and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. A stage's table goes when the next one's is written."""
    stash, docs, before = Stash(spark, "pipeline"), read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stash.put(stage(spark, docs, sf_dir))
        if before:
            stash.drop(before)
        before = path
    return docs
