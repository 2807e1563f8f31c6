"""A training-data pipeline over the documents table: each stage calls one operator on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewright.llm import best_fit_packing, decontamination, pii, simhash_dedup, toxicity
from scorewright.llm.common import materialise, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    small_batches(spark)
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, terms that disclose it are generalised or removed; every document stays."""
    return pii.sanitise(docs, everywhere=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the training sequences."""
    small_batches(spark)
    return best_fit_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", dedup),
    ("decontamination", decontaminate),
    ("pii", sanitise),
    ("best_fit_packing", packing),
]

#: No SQL: a trained classifier, fingerprints and an online packing can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
