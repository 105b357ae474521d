"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulespark.llm import stages
from rulespark.llm.runtime import dropped, scratch, staged

STAGES = [
    ("language", stages.language),
    ("near_dup", stages.near_dup),
    ("substring", stages.substring),
    ("decontaminate", stages.decontaminate),
    ("packing", stages.packing),
]

#: SQL can't express the models and the order of packing. Tests hold run() against the stages' operators and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that every stage kept, and their places. A stage's result is written and read again; what
    it staged on the way, and the result before it, is then deleted. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as keep:
            made = keep(staged(stage(spark, docs, sf_dir), name))
        if hasattr(docs, "staged_path"):
            dropped(docs)
        docs = made
    return docs
