"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows (`window` consecutive words; a shorter item is one window). A window is the set
of its shingles. A document contains a window when it has all its shingles in order, so the containment threshold is 1
and the necessary prefix of a window, under any global order, is its first shingle. The order is by rarity: shingles
are counted over all documents, and each window is indexed by its rarest one. A document's shingles are looked up among
those prefix shingles; a hit proposes one position for the window, which the length and position bounds may rule out,
and the words of the window are then compared one by one.

The join's smaller side, the windows under their prefix shingles, is dealt to files of bounded size on shared storage, each
with its sorted keys and a sieve of them. A task holds HELD bytes of documents and joins them with one file after another,
so it reads a file once for each HELD bytes of its documents; neither the number of benchmark items nor that of documents
is limited, and documents are never shuffled. An index of few files is kept by the task, and read once.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, SHINGLE = 10, 5
#: Windows in one file of the index (about 200 bytes each); files that a task keeps; bytes of documents that are joined with
#: one file after another, if there are more.
CHUNK_WINDOWS, KEPT, HELD = 200_000, 4, 32 << 20
#: Word bytes: digits, letters and everything beyond ASCII.
TABLE = common.fold_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])


@lru_cache(maxsize=KEPT)
def _load(path: str) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(common.read_bytes(path))))


def _save(path: str, arrays: dict[str, np.ndarray]) -> str:
    out = io.BytesIO()
    np.savez(out, **arrays)
    common.write_bytes(path, out.getvalue())
    return path


def _among(values: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the values that are keys, and where the first such key stands. keys are sorted."""
    maybe = np.flatnonzero(sieve[(values & np.uint64(len(sieve) - 1)).astype(np.int64)])
    at = np.searchsorted(keys, values[maybe])
    at[at == len(keys)] = 0
    same = keys[at] == values[maybe] if len(keys) else np.zeros(0, bool)
    return maybe[same], at[same]


def _sieve(keys: np.ndarray) -> np.ndarray:
    bits = max(16, int(np.ceil(np.log2(max(1, len(keys)) * 16))))
    out = np.zeros(1 << bits, bool)
    out[(keys & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def _windows(items: list[tuple[int, bytes]], window: int, shingle: int) -> dict[str, np.ndarray]:
    """All windows of some items: item, number of words, word hashes (padded by 0), shingle hashes (padded by 0)."""
    found: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray]] = {}
    for item, text in items:
        data = np.frombuffer(text, np.uint8)
        h = common.words(data, np.array([0, len(data)]), TABLE)[3]
        for at in range(max(1, len(h) - window + 1) if len(h) else 0):
            own = h[at : at + window]
            found[(item, own.tobytes())] = (own, common.shingles(own, np.zeros(len(own), np.int64), min(shingle, len(own)))[0])
    n = len(found)
    out = {"item": np.zeros(n, np.int64), "size": np.zeros(n, np.int64), "words": np.zeros((n, window), np.uint64), "shingles": np.zeros((n, window), np.uint64)}
    for k, ((item, _), (own, sh)) in enumerate(found.items()):
        out["item"][k], out["size"][k] = item, len(own)
        out["words"][k, : len(own)], out["shingles"][k, : len(sh)] = own, sh
    out["keys"] = np.unique(out["shingles"][out["shingles"] != 0])
    out["sieve"] = _sieve(out["keys"])
    return out


def _chunks(benchmark: DataFrame, base: str, window: int, shingle: int) -> list[str]:
    """The windows of all items, in files of bounded size. Paths only reach the driver."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: list[tuple[int, bytes]] = []
        words = 0

        def flush() -> pa.RecordBatch:
            path = _save(f"{base}/windows-{uuid.uuid4().hex}.npz", _windows(held, window, shingle))
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.append((item, text))
                words += len(text) // 2
                if words >= CHUNK_WINDOWS:
                    yield flush()
                    held, words = [], 0
        if held:
            yield flush()

    items = common.wanted(benchmark, item_id="long", text="string").where("item_id IS NOT NULL AND text IS NOT NULL")
    return sorted(r.path for r in items.mapInArrow(write, "path string").collect())


def _held(batches: Iterator[pa.RecordBatch], files: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together to HELD bytes if there are more files than a task keeps."""
    if files <= KEPT:
        yield from batches
        return
    own: list[pa.RecordBatch] = []
    for batch in batches:
        own.append(batch)
        if sum(b.nbytes for b in own) >= HELD:
            yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            own = []
    if own and sum(b.num_rows for b in own):
        yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]


def _tokenised(texts: pa.Array) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first row, rows, and each word's row and hash."""
    return [(first, len(offsets) - 1, *common.words(data, offsets, TABLE)[2:]) for first, data, offsets in common.text_slices(texts)]


def _matched(texts: pa.Array, indexed: list[str], window: int) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """For each text: its words, its words that are hit, and the items whose windows occur."""
    slices = _tokenised(texts)
    n_words, n_hit = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    items: list[set[int]] = [set() for _ in range(len(texts))]
    marks = [np.zeros(len(h) + 1, np.int64) for *_, h in slices]
    for path in indexed:
        chunk = _load(path)
        for (first, _, row, h), mark in zip(slices, marks, strict=True):
            for n in np.unique(chunk["width"]):
                values, head = common.shingles(h, row, int(n))
                got, at = _among(values, chunk["key"], chunk["sieve"])
                while len(got):
                    start = head[got] - chunk["back"][at]
                    size = chunk["size"][at]
                    fits = (chunk["width"][at] == n) & (start >= 0) & (start + size <= len(h))
                    fits[fits] &= row[start[fits]] == row[start[fits] + size[fits] - 1]
                    s, a, z = start[fits], at[fits], size[fits]
                    same = np.ones(len(s), bool)
                    for k in range(window):
                        there = k < z
                        same &= ~there | (h[np.minimum(s + k, len(h) - 1)] == chunk["words"][a, k])
                    np.add.at(mark, s[same], 1)
                    np.add.at(mark, s[same] + z[same], -1)
                    for r, item in set(zip((row[s[same]] + first).tolist(), chunk["item"][a[same]].tolist(), strict=True)):
                        items[r].add(item)
                    at = at + 1  # further windows under the same key
                    more = at < len(chunk["key"])
                    got, at = got[more], at[more]
                    more = chunk["key"][at] == values[got]
                    got, at = got[more], at[more]
    for (first, n, row, _), mark in zip(slices, marks, strict=True):
        n_words[first : first + n] = np.bincount(row, minlength=n)
        n_hit[first : first + n] = np.bincount(row[np.cumsum(mark[:-1]) > 0], minlength=n)
    return n_words, n_hit, items


def index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> list[str]:
    """Build the index of a benchmark's windows, each under its shingle that is rarest in docs: paths of its files."""
    spark = docs.sparkSession
    base = common.fresh_path(spark, "benchmark")
    rows = common.wanted(docs, doc_id="long", text="string")
    paths = _chunks(benchmark, base, window, shingle)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each shingle of the windows occurs, for one part of the documents."""
        sums: dict[str, np.ndarray] = {}
        for batch in _held(batches, len(paths)):
            slices = _tokenised(batch.column(1))
            for path in paths:
                chunk = _load(path)
                n_keys = len(chunk["keys"])
                sums.setdefault(path, np.zeros(n_keys, np.int64))
                for n in np.unique(np.minimum(chunk["size"], shingle)):
                    for _, _, row, h in slices:
                        values, _ = common.shingles(h, row, int(n))
                        sums[path] += np.bincount(_among(values, chunk["keys"], chunk["sieve"])[1], minlength=n_keys)
        for path, n in sums.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(_load(path)["keys"][full].view(np.int64)), "path": pa.array([path] * len(full), pa.string()), "n": pa.array(n[full])})

    counted = rows.mapInArrow(count, "shingle long, path string, n long").groupBy("path", "shingle").agg(F.sum("n").alias("n"))

    def indexed(path: str, shingle_counts: tuple[np.ndarray, np.ndarray]) -> str:
        chunk = _load(path)
        known, n = shingle_counts
        order = np.argsort(known)
        known, n = known[order], n[order]
        sh = chunk["shingles"]
        at = np.searchsorted(known, sh)
        at[at >= len(known)] = 0
        rarity = np.where(known[at] == sh, n[at], 0) if len(known) else np.zeros(sh.shape, np.int64)
        rarity = np.where(sh == 0, np.iinfo(np.int64).max, rarity)
        prefix = np.lexsort((sh, rarity), axis=1)[:, 0] if len(sh) else np.zeros(0, np.int64)
        key = sh[np.arange(len(sh)), prefix]
        by = np.argsort(key, kind="stable")
        width = np.minimum(chunk["size"], shingle)
        return _save(path.replace("/windows-", "/index-"), {"key": key[by], "back": prefix[by], "width": width[by], "item": chunk["item"][by], "size": chunk["size"][by], "words": chunk["words"][by], "sieve": _sieve(key)})

    def build(pdf):
        import pandas as pd

        path = pdf["path"].iloc[0]
        own = pdf[pdf["n"] > 0]
        return pd.DataFrame({"path": [indexed(path, (own["shingle"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64)))]})

    # a group is one file of the index, so its size is bounded
    every = spark.createDataFrame([(p,) for p in paths], "path string").selectExpr("path", "cast(0 AS long) shingle", "cast(0 AS long) n") if paths else None
    return sorted(r.path for r in counted.unionByName(every).groupBy("path").applyInPandas(build, "path string").collect()) if paths else []


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), items (ids whose windows occur,
    each once, ascending). Null or word-less texts have zeros and no items; so has every document if no item has words.
    Repeated rows give repeated results; a null doc_id stays null; other columns are ignored.
    Words are compared by 64-bit hashes of their folded bytes."""
    indexed = index(docs, benchmark, window, shingle)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches, len(indexed)):
            n_words, n_hit, items = _matched(batch.column(1), indexed, window)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_hit", "items"])

    return common.wanted(docs, doc_id="long", text="string").mapInArrow(match, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with their columns; each row is judged by its text, so
    repeated rows stay or go alike. Null, empty and word-less texts stay; so does all if no item has words."""
    indexed = index(docs, benchmark)
    return common.kept(docs, lambda texts: _matched(texts, indexed, WINDOW)[1] == 0, lambda batches: _held(batches, len(indexed)))
