"""Content-defined chunks of bodies, their registry, and bodies put together again."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.storage import joined, settled
from .dedup import first_seen

CHUNKS = "path string, seq int, offset long, len int, hash string, payload binary"
_WORD = 1 << 64
#: Bytes of bodies that a task gathers before it hands them on.
_HELD = 16 << 20


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """A random-looking number for each byte, by a congruential rule."""
    x, out = fixed.GEAR_SEED, []
    for _ in range(256):
        x = (x * fixed.GEAR_FACTOR + fixed.GEAR_TERM) % _WORD
        out.append(x)
    return np.array(out, np.uint64)


def _candidates(h: np.ndarray, mask: int) -> np.ndarray:
    return np.flatnonzero((h & np.uint64(mask)) == 0)


def boundaries(body: bytes) -> list[int]:
    """Ends of the chunks. The hash of a position looks back 64 bytes at most, and starts anew behind each chunk's
    least size; so it is taken for all positions at once, and only the first 64 of a chunk are summed one by one."""
    n = len(body)
    if n <= fixed.CHUNK_MIN:
        return [n] if n else []
    g = gear()[np.frombuffer(body, np.uint8)]
    h = g.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint64(shift))
    small, large = _candidates(h, fixed.CHUNK_MASK_SMALL), _candidates(h, fixed.CHUNK_MASK_LARGE)
    ends, at = [], 0
    while n - at > fixed.CHUNK_MIN:
        ends.append(at := _next(g, small, large, at, n))
    return ends + [n] * (at < n)


def _next(g: np.ndarray, small: np.ndarray, large: np.ndarray, at: int, n: int) -> int:
    first, middle, last = at + fixed.CHUNK_MIN, min(n, at + fixed.CHUNK_AVG), min(n, at + fixed.CHUNK_MAX)
    warm, h = min(first + 64, last), 0
    for i, value in enumerate(g[first:warm].tolist(), first):
        h = (2 * h + value) % _WORD
        if h & (fixed.CHUNK_MASK_SMALL if i < middle else fixed.CHUNK_MASK_LARGE) == 0:
            return i + 1
    for cuts, low, high in ((small, warm, middle), (large, max(warm, middle), last)):
        k = int(np.searchsorted(cuts, low))
        if k < len(cuts) and cuts[k] < high:
            return int(cuts[k]) + 1
    return last


def chunked(entries: DataFrame, path: str = "rel", body: str = "body") -> DataFrame:
    """A row for each chunk of each body: path, seq, offset, len, hash (SHA-256) and payload. Empty bodies have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, rows = 0, []
                for seq, end in enumerate(boundaries(data or b"")):
                    part = data[at:end]
                    rows.append((name, seq, at, end - at, hashlib.sha256(part).hexdigest(), part))
                    at = end
                if rows:
                    columns = zip(*rows, strict=True)
                    types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "seq", "offset", "len", "hash", "payload"])

    return entries.select(F.col(path).cast("string"), F.col(body).cast("binary")).mapInArrow(cut, CHUNKS)


def registry(chunks: DataFrame) -> DataFrame:
    """Distinct chunks: chunk_id (in the order in which they first occur by path and seq), hash, len, payload."""
    ids = first_seen(chunks, "hash", "path", "seq").withColumnRenamed("id", "chunk_id")
    one = chunks.groupBy("hash").agg(F.first("len").alias("len"), F.first("payload").alias("payload"))
    return ids.join(one, "hash").select("chunk_id", "hash", "len", "payload")


def recipes(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Files as ordered chunks: path, seq, chunk_id, is_ref (the chunk has occurred before). A chunk that is not in the
    registry keeps its place, with a null chunk_id; it dangles. A chunk that very many files have is cut in the joins."""
    places = settled(chunks.select("path", "seq", "hash"), "places")
    first = places.groupBy("hash").agg(F.min(F.struct("path", "seq")).alias("_first"))
    named = joined(places, first.join(known.select("hash", "chunk_id"), "hash", "left"), ["hash"])
    return named.select("path", "seq", "chunk_id", (F.struct("path", "seq") != F.col("_first")).alias("is_ref"))


def reassembled(recipe: DataFrame, known: DataFrame) -> DataFrame:
    """Bodies from recipes: path and body; dangling counts chunks that are not in the registry, and the body is then
    null. A task reads its files' chunks in order, and holds one file's at a time."""
    recipe = settled(recipe.select("path", "seq", "chunk_id"), "recipes")
    found = joined(recipe, known.select("chunk_id", "payload"), ["chunk_id"], "left").select("path", "seq", "payload")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, parts, dangling = None, [], 0
        done: list[tuple] = []

        def row() -> tuple:
            return path, dangling, None if dangling else b"".join(parts)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["path", "dangling", "body"])

        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != path and path is not None:
                    done.append(row())
                    parts, dangling = [], 0
                    if sum(len(r[2] or b"") for r in done) > _HELD or len(done) >= 1000:
                        yield batch_of(done)
                        done = []
                path = name
                if payload is None:
                    dangling += 1
                else:
                    parts.append(payload)
        if path is not None:
            yield batch_of([*done, row()])

    ordered = found.repartition("path").sortWithinPartitions("path", "seq").select("path", "payload")
    return ordered.mapInArrow(put, "path string, dangling long, body binary")


def savings(chunks: DataFrame) -> DataFrame:
    """chunks, distinct chunks, bytes, distinct bytes and the share that is saved."""
    each = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.first("len").alias("len"))
    return each.agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("n") * F.col("len")).alias("bytes"), F.sum("len").cast("long").alias("distinct_bytes")).withColumn("saved", F.lit(1.0) - F.col("distinct_bytes") / F.col("bytes"))
