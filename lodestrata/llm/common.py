"""What the operators of this subpackage share: shared storage, Arrow text slices, vectorised word hashing."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import storage

#: Bytes of text that one vectorised step handles; temporaries are about 30 times as large.
SLICE_BYTES = 2 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


#: Rows of an Arrow batch, where the session has Spark's default of ten times as many; texts can be long.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless it has set a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """A table; costly rows of a small scan are spread over all cores."""
    bound_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return storage.spread(rows) if costly else rows


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster shares; what is there goes when the application ends."""
    bound_batches(spark)
    return storage.shared_path(spark, what)


def dropped(spark: SparkSession, path: str) -> None:
    storage.dropped(spark, path)


def settled(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """The rows written to shared storage once and read back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that may be hot at once, and rows up to which no key is.
HUBS, COLD = 1_000, 32


def dealt_join(rows: DataFrame, table: DataFrame, by: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to a table of one row a key, whose column n (left out of the result) says how many of the `total` rows
    have that key. A key with more than total / HUBS of them is hot: there are HUBS at most, so their part of the table is
    broadcast and their rows stay where they are; only the others are dealt out by their key. Both are read twice, so
    they are to be written tables, or cheap."""
    most = max(COLD, total // HUBS)
    hot = table.where(f"`{n}` > {most}").drop(n)
    cold = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(table.where(f"`{n}` <= {most}").drop(n), by, how)
    return cold.unionByName(rows.join(F.broadcast(hot), by))


def wanted(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; other columns, whatever their names, are left out."""
    return df.select(*(df[f"`{name}`"].cast(kind).alias(name) for name, kind in types.items()))


def kept(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], held: Callable[[Iterator], Iterator] = iter) -> DataFrame:
    """The rows of docs, with all their columns, whose text passes; keep takes a batch's texts, held may put batches
    together. Rows stay where they are: no join, no shuffle, and rows that share an id, or have none, are judged one by one."""
    place = docs.columns.index("text")
    bound_batches(docs.sparkSession)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            yield batch.filter(pa.array(keep(batch.column(place)), pa.bool_()))

    return docs.mapInArrow(filtered, docs.schema)


def small(df: DataFrame, most: int = 250_000) -> DataFrame:
    """The frame, to be broadcast if it has no more rows than that; for written tables, whose count is cheap."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows as (first row, bytes, offsets of length rows + 1). Null texts have no bytes.
    A slice holds at most `rows` rows, and at most `most` bytes unless a single row is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    ends = np.cumsum(lengths)
    first = 0
    while first < n:
        done = ends[first - 1] if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, done + most, side="right"))))
        own = lengths[first:last]
        if offsets[last] - offsets[first] == own.sum():
            part = data[offsets[first] : offsets[last]]
        else:  # a null row with bytes under it
            part = np.concatenate([data[offsets[i] : offsets[i] + lengths[i]] for i in range(first, last)] or [data[:0]])
        yield first, part, np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _MULT, np.uint64)]), dtype=np.uint64)
    return _POWERS[:n]


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, table256: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: (start, end, row, 64-bit hash). table256 maps bytes to their folded form, separators to 32.
    Words never cross rows. The hash is a polynomial over folded bytes, so equal words hash equally everywhere."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, np.zeros(0, np.uint64)
    folded = np.frombuffer(data.tobytes().translate(table256), dtype=np.uint8)
    inside = folded != 32
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    opens[heads] = inside[heads]
    closes = np.empty_like(inside)
    closes[:-1] = inside[:-1] & (~inside[1:] | opens[1:])
    closes[-1] = inside[-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, start, side="right") - 1
    # position within the word as the exponent, so that a word's hash does not depend on where it stands
    length = end - start
    flat = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    within = flat - np.repeat(start, length)
    terms = _BYTE_CODES[folded[flat]] * _powers(int(length.max()))[within]
    sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(length)[:-1]]))
    return start, end, row, mixed(sums + length.astype(np.uint64) * _MULT)


def shingles(word_hash: np.ndarray, word_row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the index of each one's first word."""
    if len(word_hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(word_row[: len(word_row) - n + 1] == word_row[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * _MULT + word_hash[at + k]
    return mixed(total + np.uint64(n)), at


def fold_table(separators: bytes, lower: bool = True) -> bytes:
    """A table for words(): A-Z folded if asked, separators, of which the blank must be one, to the blank."""
    out = bytearray(range(256))
    if lower:
        for c in range(65, 91):
            out[c] = c + 32
    for c in separators:
        out[c] = 32
    return bytes(out)


def write_bytes(path: str, body: bytes) -> None:
    """To a URI of shared storage, under a name that no other attempt uses."""
    fs, at = filesystem(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(body)


def read_bytes(path: str) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as source:
        return source.read()


#: Names under which Hadoop knows file systems that have another one here.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(path: str):
    """The file system of a URI, for tasks, and the path in it: local files, HDFS, S3, GCS and Azure by Hadoop's names."""
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    if not rest:
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
