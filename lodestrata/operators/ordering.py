"""Orders and partitions of entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.storage import settled

#: The least share of bytes for which media go a way of their own.
GATE = 0.20


def solid_key() -> list[Column]:
    """Directories, links, files; then extension, parent folder, size and path, all in lower case; the path itself last."""
    rank = F.when(F.col("kind") == 1, 0).when(F.col("kind") == 2, 1).otherwise(2)
    parent = F.lower(F.regexp_extract("rel", "^(.*)/[^/]*$", 1))
    return [rank, F.col("ext"), parent, F.col("size"), F.lower("rel"), F.col("rel")]


def solid_sort(entries: DataFrame) -> DataFrame:
    """A range-partitioned sort; no task sees all rows."""
    return entries.orderBy(*solid_key())


def numbered(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """The rows with a number from 0 in the order of the keys. They are ranged and sorted by the keys in one exchange and
    written with their range and their place in it; the numbers are taken from what was written, so that the rows and the
    counts of the ranges cannot come from two exchanges with bounds of their own."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    ranged = keyed.repartitionByRange(*names).sortWithinPartitions(*names)
    # the id is the partition's number in its upper bits and the row's place below
    own = settled(ranged.withColumn("_id", F.monotonically_increasing_id()).drop(*names), "ranges").withColumn("_part", F.shiftright("_id", 33))
    counts = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_id", "_before")


def solid_position(entries: DataFrame) -> DataFrame:
    """The entries with `position`, from 0, in solid order. They are written once with all their columns, so leave out
    those that are not needed."""
    return numbered(entries, solid_key(), "position")


def stored_as_is() -> Column:
    """Whether an entry is one that the router stores as it is."""
    return scalars.routed(F.col("ext")) & F.col("is_regular")


def route(entries: DataFrame, gate: float = GATE) -> DataFrame:
    """The entries with `bucket`, media or default; all default if media have less than `gate` of the bytes. The share is
    one row, which every task gets."""
    is_media = stored_as_is()
    whole = entries.where("is_regular").agg(F.coalesce(scalars.share(F.sum(F.when(is_media, F.col("size")).otherwise(0)), F.sum("size")), F.lit(0.0)).alias("_share"))
    return entries.join(F.broadcast(whole)).withColumn("bucket", F.when(is_media & (F.col("_share") >= gate), "media").otherwise("default")).drop("_share")


def first(entries: DataFrame, n: int, *by: str) -> DataFrame:
    """The first n rows by a key, as for failed paths or the entries that a detector samples."""
    return entries.orderBy(*(by or ("rel",))).limit(n)


def sampled(entries: DataFrame, cap: int = 16 << 20, head: int = 256 << 10) -> DataFrame:
    """Entries in solid order until their heads (at most `head` bytes each) reach `cap` bytes; the one that crosses it is
    the last. Ranges of the order are summed first, then only those before the cap are looked into."""
    files = entries.where("is_regular AND size > 0")
    placed = (files if "position" in files.columns else solid_position(files)).withColumn("head", F.least("size", F.lit(head)))
    block = F.floor(F.col("position") / 4096)
    sums = placed.groupBy(block.alias("block")).agg(F.sum("head").alias("n"))
    before = sums.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below")).where(F.col("_below") < cap)
    near = placed.withColumn("block", block).join(F.broadcast(before), "block")
    running = F.coalesce(F.sum("head").over(Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("running", F.col("_below") + running).where(F.col("running") < cap).drop("block", "_below")


def split_parts(writes: DataFrame, limit: int) -> DataFrame:
    """The part of each write (position, size; positions from 0 or 1 without gaps) when a new part begins after one has
    grown beyond `limit`. Where a part begins depends on all writes before, so one task reads the sizes of all writes as
    a stream in their order (16 bytes each, never held together) and gives the first write of each part. The writes are
    then looked up among these by blocks of positions."""
    sized = settled(writes.select(F.col("position").cast("long"), F.col("size").cast("long")), "writes")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, part = 0, 0
        for batch in batches:
            position, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(position):
                continue
            ends, found = np.cumsum(size), []
            if not part:
                part, _ = 1, found.append((int(position[0]), 1))
            at = 0
            while True:
                below = grown - (int(ends[at - 1]) if at else 0)  # what ends must be lowered by, less
                k = int(np.searchsorted(ends, limit - below, side="right"))
                if k >= len(ends):
                    grown = below + int(ends[-1])
                    break
                part, grown, at = part + 1, 0, k + 1  # the write that crosses the limit still belongs to the part
                found.append((int(position[k]) + 1, part))
                if at >= len(ends):
                    break
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32())], names=["first", "part"])

    first = settled(sized.repartitionByRange(1, "position").sortWithinPartitions("position").mapInArrow(starts, "first long, part int"), "parts")
    last = sized.agg(F.max("position")).first()[0]
    # each part's head in every block of positions that it reaches into, then the writes behind it
    block = 1 << 16
    until = F.coalesce(F.lead("first").over(Window.orderBy("first")) - 1, F.lit(last))
    spans = first.select("first", "part", until.alias("_until")).where("_until >= first")
    reach = spans.select("first", "part", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("_until") / block))).alias("_block"))
    heads = reach.select("_block", F.greatest(F.col("first"), F.col("_block") * block).alias("position"), F.lit(None).cast("long").alias("size"), "part", F.lit(True).alias("_head"))
    every = heads.unionByName(sized.select(F.floor(F.col("position") / block).alias("_block"), "position", "size", F.lit(None).cast("int").alias("part"), F.lit(False).alias("_head")))
    behind = Window.partitionBy("_block").orderBy("position", F.desc("_head")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn("part", F.last("part", ignorenulls=True).over(behind)).where("NOT _head").select("position", "size", "part")
