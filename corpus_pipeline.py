"""The pipeline over `documents`: toxicity, n-gram join, decontamination, secrets, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import common, stages

STAGES = stages.STAGES
#: The toxicity model and the piece matching have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are written to shared storage and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
