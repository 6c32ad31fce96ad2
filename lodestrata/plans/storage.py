"""Tables that queries write for themselves, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task gets before the key is cut, and rows up to which a frame is broadcast.
HOT, BROADCAST = 200_000, 100_000


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder only in local mode, if that is unset. What an
    application has written there goes when it ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/lodestrata/{spark.sparkContext.applicationId}"
    fs, at = file_system(spark, own)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """The rows written to shared storage once and read back. Whatever reads them, in how many branches so ever, sees the
    same rows with the same numbers."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, twice, if a scan gives fewer: for work on few but costly rows. A
    scan of a large table has more, and stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def joined(rows: DataFrame, table: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined to a table that has one row a key, where any number of rows may have one key; both settled, or cheap
    to read. A key of more rows than HOT is cut: its rows are dealt out by their hash, and its row of the table is
    repeated once for each cut. There are BROADCAST such keys at most, whatever the number of rows."""
    n = rows.count()
    most = max(HOT, n // BROADCAST)
    cut = rows.groupBy(*by).agg(F.ceil(F.count("*") / most).cast("int").alias("_cuts")).where("_cuts > 1") if n > most else None
    if cut is None or not (cut := settled(cut, "hot")).limit(1).count():
        return rows.join(table, by, how)
    cut = F.broadcast(cut)
    dealt = rows.join(cut, by, "left").withColumn("_cut", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_cuts", F.lit(1))).cast("int")).drop("_cuts")
    copied = table.join(cut, by, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1))).drop("_cuts")
    return dealt.join(copied, [*by, "_cut"], how).drop("_cut")


def dropped(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)
