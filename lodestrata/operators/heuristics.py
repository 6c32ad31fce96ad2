"""Classifiers that look at a few entries' first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import solid_key

#: Entries that are looked at, bytes of each, least samples.
LOOKED_AT, HEAD, LEAST = 64, 20, 4


def executable(entries: DataFrame, ordered: bool = True) -> DataFrame:
    """One row: samples, hits and branch ('x86' or 'none'), from the first 64 entries in solid order, of which regular
    ones of 20 bytes or more count. A hit is an ELF of machine 0x3E or 0x03, or begins with MZ."""
    heads = entries.withColumn("head", F.substring("body", 1, HEAD)).drop("body")  # only these are sorted
    first = heads.orderBy(*solid_key()) if ordered else heads
    seen = first.limit(LOOKED_AT).where((F.col("is_regular")) & (F.octet_length("head") >= HEAD)).select("head")
    machine = F.hex(F.substring("head", 19, 2))
    hit = (F.startswith("head", F.lit(b"\x7fELF")) & machine.isin("3E00", "0300")) | F.startswith("head", F.lit(b"MZ"))
    counted = seen.agg(F.count("*").alias("samples"), F.count_if(hit).alias("hits"))
    return counted.withColumn("branch", F.when((F.col("samples") >= LEAST) & (F.col("hits") * 10 >= F.col("samples") * 3), "x86").otherwise("none"))
