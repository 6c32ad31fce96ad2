"""Connected components of an edge table: what a task has of it is contracted to stars, then alternating stars tie the
tasks' together; every round is two joins and two aggregations, and there is none if all edges are in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task contracts at once.
TIED = 1_000_000


def _tied(rows: DataFrame, n: int, what: str) -> tuple[DataFrame, str]:
    """rows (u, v) with m, the least of u and all v beside it; and where the table of these is. A node with very many
    neighbours is found by partial aggregation, and its least is sent to the tasks that have its rows."""
    path = common.fresh_path(rows.sparkSession, what)
    least = common.settled(rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), what, path)
    return common.dealt_join(rows, least, ["u"], "n", n), path


def _star(edges: DataFrame, n: int, what: str) -> tuple[DataFrame, str]:
    """Each node's greater neighbours are tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tied, path = _tied(both, 2 * n, what)
    large = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.where("u <> v").distinct(), path


def _small(edges: DataFrame, n: int, what: str) -> tuple[DataFrame, str]:
    """Every edge (u, v), u > v: u and its smaller neighbours are tied to the least of them."""
    tied, path = _tied(edges, n, what)
    low = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
    return low.where("u <> v").distinct(), path


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node that it reaches by the given ones), one for each node but those least ones."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return ids[tied], ids[root[tied]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components, at most one for each node in TIED edges of a task."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tied() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TIED:
                yield tied()
                held, n = [], 0
        if n:
            yield tied()

    return edges.mapInArrow(contract, "u long, v long")


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end has one lower end, which is itself no upper end: the lower ends are the roots then."""
    ends = edges.selectExpr("u AS id", "1 AS above", "0 AS below").unionByName(edges.selectExpr("v AS id", "0 AS above", "1 AS below"))
    return not ends.groupBy("id").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 OR above = 1 AND below = 1").limit(1).count()


def components(edges: DataFrame, what: str) -> DataFrame:
    """(id, root) for every node of edges (u long, v long): root is the least id that it reaches.
    Loops, repeated edges and edges with a null end are allowed and add nothing. Tables of earlier rounds are deleted."""
    spark = edges.sparkSession
    path = common.fresh_path(spark, what)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.settled(_contracted(now), what, path)
    while not _stars(now):
        n = now.count()
        large, first = _star(now, n, what)
        middle = common.fresh_path(spark, what)
        large = common.settled(large, what, middle)
        after = common.fresh_path(spark, what)
        small, second = _small(large, 2 * n, what)  # as many rows at most
        now = common.settled(small, what, after)
        for done in (path, first, middle, second):
            common.dropped(spark, done)
        path = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
