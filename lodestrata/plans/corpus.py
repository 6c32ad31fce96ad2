"""The driver's documents as a set of entries, which every operator over entries takes.

Names get extensions and times by doc_id, so that selectors and classifiers have something to tell apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

#: The extension of an entry by doc_id % 10, and the first time.
SUFFIXES = [".txt", ".jpg", ".PNG", ".mp4", ".pdf", ".md", "", ".jpeg", ".deb", ".zip"]
FIRST_TIME = 1_577_836_800


def entries(docs: DataFrame) -> DataFrame:
    """rel, full, kind, is_regular, size, mtime, ext, text and doc_id of each document."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.pmod("doc_id", F.lit(len(SUFFIXES))) + 1).cast("int"))
    rel = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), suffix)
    named = docs.select("doc_id", "text", rel.alias("rel"), F.lit(0).alias("kind"), F.lit(True).alias("is_regular"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), (F.lit(FIRST_TIME) + F.pmod("doc_id", F.lit(1000)) * 86_400).alias("mtime"))
    return named.withColumn("ext", scalars.extension(F.col("rel"))).withColumn("full", F.concat(F.lit("/corpus/"), "rel"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in DuckDB's SQL, as a common table expression.
CORPUS_SQL = """named AS (
    SELECT doc_id, text, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id
        || ['.txt', '.jpg', '.PNG', '.mp4', '.pdf', '.md', '', '.jpeg', '.deb', '.zip'][doc_id % 10 + 1] AS rel,
        0 AS kind, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size, 1577836800 + (doc_id % 1000) * 86400 AS mtime FROM documents),
corpus AS (
    SELECT *, lower(regexp_extract(rel, '[^/]\\.([^./]*)$', 1)) AS ext, '/corpus/' || rel AS full_path,
        CASE WHEN doc_id % 10 IN (1, 7) THEN 'Jpeg' WHEN doc_id % 10 = 2 THEN 'Png' WHEN doc_id % 10 IN (3, 4, 9) THEN 'Media' ELSE 'Other' END AS content
    FROM named)"""
