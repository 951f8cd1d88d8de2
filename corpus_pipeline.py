"""Cleaning a corpus in stages; each function takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns documents with the columns that it was given. run() writes each
stage's result as Parquet into the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, importance, near_copies, packing, quality_rules
from gridloom.llm.tokens import public_path
from gridloom.llm.work import table, work_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards labelled good text keeps."""
    return docs.where(importance.Sampler(docs, table(spark, sf_dir, "labels")).kept())


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return near_copies.one_of_each(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences in sequences of 2048."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"), end_id=1, room=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
