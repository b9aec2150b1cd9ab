"""The training-data pipeline: quality rules, language ID, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import documents, materialize
from graphloom.llm.language_id import language_stage
from graphloom.llm.near_copies import dedup_stage
from graphloom.llm.packing import pack
from graphloom.llm.quality_rules import quality_stage


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents that are left, in its sequence."""
    return pack(spark, docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained profiles, fingerprints and greedy packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
