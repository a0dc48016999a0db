"""A corpus pipeline: languages, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, and returns a DataFrame that is written as
Parquet and read again before the next stage. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from compatlake.llm import exact_dedup, language_id, packing, secret_scan, simhash_dedup
from compatlake.llm.common import Stored


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay; those without a letter go."""
    return language_id.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays."""
    return simhash_dedup.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, also those joined to known spans or sample words; every document stays."""
    return secret_scan.redacted(docs, cut=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in bins."""
    return packing.pack(packing.documents(docs))


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: Models, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is stored in the shared folder."""
    stored = Stored(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for before, (name, stage) in zip([None, *STAGES], STAGES):
        docs = stored.keep(stage(spark, docs, sf_dir), name)
        if before:
            stored.drop(before[0])
    return docs
