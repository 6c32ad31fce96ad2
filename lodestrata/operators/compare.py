"""Comparison of sets of entries by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """rel and status of every path of two indexes (rel, size, crc32): only<A, only>B, differ or match. What has no size or digest on either side can't be told to be the same, so it differs."""
    left, right = (x.select("rel", F.struct("size", "crc32").alias(n)) for x, n in ((a, "a"), (b, "b")))
    status = F.when(F.col("b").isNull(), "only<A").when(F.col("a").isNull(), "only>B").when(F.col("a") != F.col("b"), "differ").otherwise("match")
    return left.join(right, "rel", "full").select("rel", status.alias("status"))


def listed(a: DataFrame, b: DataFrame) -> DataFrame:
    """compare()'s rows in the order in which they are shown: by status, then path."""
    return compare(a, b).orderBy("status", "rel")


def compared_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    return compare(a, b).groupBy("status").agg(F.count("*").alias("n"))


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose path b lacks."""
    return a.join(b.select("rel"), "rel", "left_anti")


def matching(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("rel", "size", "crc32"), ["rel", "size", "crc32"], "left_semi")


def verify(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Each archived entry (rel, kind, size, crc32, stored_crc32) against live ones (rel, size, crc32): miss, diff or ok.
    crc32 is of the body that the archive gives, stored_crc32 of what it was made from; where that is null, none was
    stored. A file whose body is missing on either side, so that it has no digest, is a diff. Entries that are no files
    only have to be there. Live entries that are not archived are not reported."""
    seen = live.select("rel", F.col("size").alias("live_size"), F.col("crc32").alias("live_crc32"), F.lit(True).alias("_there"))
    same = (F.col("size") == F.col("live_size")) & (F.col("crc32") == F.col("live_crc32")) & (F.col("crc32") == F.coalesce("stored_crc32", "crc32"))
    status = F.when(F.col("_there").isNull(), "miss").when(scalars.file_like(F.col("kind")) & ~F.coalesce(same, F.lit(False)), "diff").otherwise("ok")
    return archive.join(seen, "rel", "left").select("rel", status.alias("status"))


def verified_counts(archive: DataFrame, live: DataFrame) -> DataFrame:
    status = F.col("status")
    return verify(archive, live).agg(F.count("*").alias("entries"), F.count_if(status == "miss").alias("miss"), F.count_if(status == "diff").alias("diff"), F.count_if(status == "ok").alias("ok"))


def resolved_links(entries: DataFrame) -> DataFrame:
    """Hard links (rel, link_target) with the size and kind of what they name; found is false where nothing has that path."""
    target = entries.select(F.col("rel").alias("link_target"), F.col("kind").alias("target_kind"), F.col("size").alias("target_size"))
    return entries.where("kind = 3").select("rel", "link_target").join(target, "link_target", "left").withColumn("found", F.col("target_kind").isNotNull())
