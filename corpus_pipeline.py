"""The training-data pipeline: stages over ``documents``, each written and read again.

Stages in order: language ID, exact dedup, MinHash near-dedup, mixing to target
weights, packing. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartweave.llm.exact_dedup import drop_exact_duplicates
from chartweave.llm.language import drop_undetermined
from chartweave.llm.mixing import mix
from chartweave.llm.near_dedup import drop_near_duplicates
from chartweave.llm.packing import pack_batches
from chartweave.llm.shared import write_through


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; others hold no letter."""
    return drop_undetermined(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low and toxic documents thinned towards their target weights."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of padded documents."""
    return pack_batches(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The models of the first and fourth stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
