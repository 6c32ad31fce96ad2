"""The stages of the pipeline: (spark, docs, sf_dir) -> documents, the last one with pieces.

Each stage works on all rows it is given. Toxicity and decontamination judge each row by its own text, in place; near
duplicates go by doc_id, so rows that share one stay or go together. Null and empty texts pass the first four stages
unchanged, as single documents; extra columns pass them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, ngram_join, secrets, sentencepieces, toxicity
from .common import table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the stage's own documents and `labels`."""
    return toxicity.tolerable(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are masked in the texts; all documents stay."""
    return secrets.masked(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and lossless for each document."""
    return sentencepieces.encode(docs)


STAGES = [("toxicity", toxic), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", benchmark_decontamination), ("secret_scan", secret_scan), ("sentencepiece", sentencepiece)]
