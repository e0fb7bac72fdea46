"""A training corpus from documents: language ID, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import langid, mixing, packing, secrets, simhash
from strandlog.llm.common import discard, scratch, small_batches, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    small_batches(spark)
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    small_batches(spark)
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks."""
    small_batches(spark)
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix), ("packing", packed)]

#: No SQL expresses trained models, fingerprints and packing; tests/llm/test_pipeline.py holds the rows against a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's table, and what it was made from, is deleted once the next one is written. The last one's input stays until the caller has read the rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            after = keep(written(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
