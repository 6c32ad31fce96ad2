"""Exact duplicates of entries. Sizes are grouped before contents are hashed; keys are (size, digest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import joined, settled
from .ordering import numbered, solid_key


def candidates(entries: DataFrame, digest: Column) -> DataFrame:
    """Regular entries with content whose size occurs twice, with `digest`. The sizes that occur twice are a semi join
    on one number a row, so that a size which very many entries share is no task of its own."""
    files = entries.where("is_regular AND size > 0")
    twice = files.groupBy("size").agg(F.count("*").alias("n")).where("n >= 2").select("size")
    return files.join(twice, "size", "left_semi").withColumn("digest", digest)


def groups(entries: DataFrame, digest: Column) -> DataFrame:
    """Groups of two or more: size, digest, n, keep (the least path), wasted bytes, most bytes first. Contents without a
    digest, such as those that could not be read, are equal to nothing. The order is by size, then keep."""
    return _groups(candidates(entries, digest)).orderBy(F.desc("size"), "keep")


def _groups(found: DataFrame) -> DataFrame:
    some = found.where("digest IS NOT NULL").groupBy("size", "digest").agg(F.count("*").alias("n"), F.min("rel").alias("keep"))
    return some.where("n >= 2").withColumn("wasted", F.col("size") * (F.col("n") - 1))


def members(entries: DataFrame, digest: Column) -> DataFrame:
    """Every entry of a group: size, digest, rel, role (keep or dupe). Contents are hashed once; what is joined are paths
    and digests, and a group of very many copies is cut."""
    found = settled(candidates(entries, digest).where("digest IS NOT NULL").select("size", "digest", "rel"), "candidates")
    kept = _groups(found).select("size", "digest", "keep")
    return joined(found, kept, ["size", "digest"]).select("size", "digest", "rel", F.when(F.col("rel") == F.col("keep"), "keep").otherwise("dupe").alias("role"))


def report(entries: DataFrame, digest: Column) -> DataFrame:
    """One row: scanned files, groups, redundant files, wasted bytes."""
    scanned = entries.where("is_regular AND size > 0").agg(F.count("*").alias("scanned"))
    found = _groups(candidates(entries, digest)).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))
    return scanned.join(found)


def duplicates(entries: DataFrame, digest: Column, *within: str) -> DataFrame:
    """Each entry that repeats an earlier one in solid order: full, rel and its canonical_rel. Entries are compared only
    within the given columns, such as a bucket or a batch. The first is a least struct, found by partial aggregation."""
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(solid_key())))
    by = [*within, "size", "digest"]
    found = settled(candidates(entries, digest).where("digest IS NOT NULL").select(*by, key.alias("_key"), "full", "rel"), "candidates")
    first = found.groupBy(*by).agg(F.min(F.struct("_key", "full", "rel")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return joined(found, first, by).where(F.col("full") != F.col("_first.full")).select(*within, "full", "rel", F.col("_first.rel").alias("canonical_rel"))


def linked(entries: DataFrame, dups: DataFrame) -> DataFrame:
    """The entries as they are packed: duplicates become hard links (kind 3) of size 0 to their canonical path."""
    known = dups.select("full", "canonical_rel")
    is_link = F.col("canonical_rel").isNotNull()
    return entries.join(known, "full", "left").select("rel", F.when(is_link, 3).otherwise(F.col("kind")).alias("kind"), F.when(is_link, 0).otherwise(F.col("size")).cast("long").alias("size"), F.coalesce("canonical_rel", F.lit("")).alias("link_target"))


def counted(dups: DataFrame, *within: str) -> DataFrame:
    return dups.groupBy(*within).agg(F.count("*").alias("duplicates"))


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, id) of distinct keys, ids from 0 in the order in which keys first occur."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_at"))
    return numbered(first, [F.col("_at"), F.col(key)], "id").select(key, "id")
