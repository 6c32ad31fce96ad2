"""Inventory of entries: counts, bytes, shares and percentiles. One aggregation each, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalars


def by_extension(entries: DataFrame) -> DataFrame:
    """ext, files, bytes and share of all bytes, most bytes first. The window runs over one row an extension."""
    counted = entries.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return counted.withColumn("share", scalars.share(F.col("bytes"), F.sum("bytes").over(Window.partitionBy()))).orderBy(F.desc("bytes"), "ext")


def by_category(entries: DataFrame) -> DataFrame:
    """All four kinds of content, with zeros for those that don't occur."""
    spark = entries.sparkSession
    every = spark.createDataFrame([(k, i) for i, k in enumerate(["Png", "Jpeg", "Media", "Other"])], "content string, place int")
    counted = entries.groupBy(scalars.content_kind(F.col("ext")).alias("content")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    filled = every.join(counted, "content", "left").select("content", "place", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "bytes")))
    return filled.withColumn("share", scalars.share(F.col("bytes"), F.sum("bytes").over(Window.partitionBy())))


def totals(entries: DataFrame) -> DataFrame:
    """files, dirs, symlinks, unreadable (size null) and bytes."""
    kind = F.col("kind")
    return entries.agg(F.count_if(scalars.file_like(kind)).alias("files"), F.count_if(kind == 1).alias("dirs"), F.count_if(kind == 2).alias("symlinks"), F.count_if(F.col("size").isNull()).alias("unreadable"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def plan(entries: DataFrame) -> DataFrame:
    """Counts and bytes by content, and of all (content null), in one pass."""
    return entries.where("is_regular").rollup(scalars.content_kind(F.col("ext")).alias("content")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def percentiles(entries: DataFrame) -> DataFrame:
    """Exact nearest-rank percentiles of the sizes of regular files; 0 without any."""
    at = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY size)").cast("long"), F.lit(0))
    return entries.where("is_regular").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def _kinds(entries: DataFrame) -> DataFrame:
    counted = entries.where("is_regular").groupBy(scalars.content_kind(F.col("ext")).alias("content")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return counted.withColumn("id", F.array_position(F.array(*map(F.lit, fixed.CONTENT_KINDS)), F.col("content")) - 1)


def summary_line(entries: DataFrame) -> DataFrame:
    """One line: kinds with a twentieth of the bytes or more, largest first."""
    shares = _kinds(entries).withColumn("share", scalars.share(F.col("bytes"), F.sum("bytes").over(Window.partitionBy()))).where("share >= 0.05")
    spelt = F.format_string("%s %.0f%%", F.lower("content"), F.col("share") * 100)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), F.col("id"), spelt.alias("t"))))
    return shares.agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ", ").alias("line"))


def scan_summary(entries: DataFrame) -> DataFrame:
    """total_bytes, file_count and type_dist (kind, count, bytes of the kinds that occur, in the order of ids)."""
    kind = F.struct(F.col("id").cast("tinyint").alias("kind"), F.least(F.col("files"), F.lit((1 << 32) - 1)).alias("count"), F.col("bytes"))
    return _kinds(entries).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("files"), F.lit(0)).alias("file_count"), F.array_sort(F.collect_list(kind)).alias("type_dist"))


def archive_totals(entries: DataFrame, stored: str = "stored_size") -> DataFrame:
    """files, bytes, stored bytes, their ratio and its class."""
    files = entries.where(scalars.file_like(F.col("kind")))
    summed = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(stored), F.lit(0)).alias("stored"))
    return summed.withColumn("ratio", scalars.share(F.col("stored"), F.col("bytes"))).withColumn("grade", scalars.ratio_class(F.col("ratio")))


def test_tally(checked: DataFrame, shown: int = 20) -> DataFrame:
    """Of rows (rel, kind, size, ok; ok null if nothing was stored to check): entries, verified, failed, bytes, the first
    `shown` failed paths and how many more. Failed paths are ranked before they are gathered, so few reach one task."""
    first = checked.where("NOT ok").select("rel").orderBy("rel").limit(shown).agg(F.array_sort(F.collect_list("rel")).alias("failed_paths"))
    summed = checked.agg(F.count("*").alias("entries"), F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return summed.join(first).withColumn("more", F.col("failed") - F.size("failed_paths"))


def media_share(entries: DataFrame) -> DataFrame:
    """Bytes of routed and of other regular files, and the routed ones' share."""
    is_media = scalars.routed(F.col("ext"))
    summed = entries.where("is_regular").agg(F.coalesce(F.sum(F.when(is_media, F.col("size"))), F.lit(0)).alias("media"), F.coalesce(F.sum(F.when(~is_media, F.col("size"))), F.lit(0)).alias("other"))
    return summed.withColumn("share", scalars.share(F.col("media"), F.col("media") + F.col("other")))


def packable(entries: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Bytes of regular files that are no duplicates; duplicates has `full`."""
    return entries.where("is_regular").join(duplicates.select("full"), "full", "left_anti").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("packable"))


def pack_counters(entries: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(kind == 5).alias("jpeg"), F.count_if(kind == 6).alias("png"))
