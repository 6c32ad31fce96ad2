"""Shards of near equal bytes by histogram sort, in DataFrame functions only.

The key of a row is (hash of its text, hash of its doc_id, hash of its place in the written keys): equal texts are
neighbours, and the place parts rows that are alike in all else. Splitters are found from
histograms: each round counts the exact bytes of the cells that lie between two candidate boundaries, for those cells
alone in which a splitter still has to be found, and cuts them into finer cells by the next bits of the key. A splitter
is settled once a boundary lies within the tolerance of its target; a boundary inside a group of equal texts is only
probed once those between texts were all too far off. Then rows are exchanged once, by shard and cell.

Slots count rows before a cell, from the cells' exact counts, plus the row's place within its cell. Cells that hold
too many rows, such as a text with very many copies, are cut by the second hash, and what repeats one row too often by
the third, so no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the key that one round of probes adds, the tolerance as a part of a shard, rows of a cell for slots.
BITS, TOLERANCE, CELL = 10, 1 / 200, 50_000
#: Cells for slots up to which their counts are broadcast (about 40 bytes each).
BROADCAST = 200_000

#: Rounds of probes that one hash of 64 bits gives.
_ROUNDS = -(-64 // BITS)


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _level(level: int) -> Column:
    """The key's bits of a round, as a number: the first rounds take the text's hash, then the doc_id's, then the place's."""
    name, k = "hdp"[level // _ROUNDS], level % _ROUNDS
    low = max(0, 64 - BITS * (k + 1))
    width = min(BITS, 64 - BITS * k)
    return F.shiftrightunsigned(F.col(name), low).bitwiseAND((1 << width) - 1).cast("int")


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[list[int]]:
    """For each boundary between shards the path of cells (one number for each round) below which its rows end. keyed: h,
    d, p, size. The driver gets the cells in which splitters fall, at most shards * 2 ** BITS numbers a round."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = total / shards * tolerance
    done: dict[int, list[int]] = {}
    # cells to look into: path -> (bytes below it, boundaries whose targets lie in it)
    open_: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(1, shards)))}
    rows, level = keyed, 0
    while open_:
        grain = _level(level)
        if level:
            # only the cells that hold a target are looked into again
            known = [F.array(*map(F.lit, p)) for p in open_]
            rows = rows.withColumn("path", F.array(*(_level(k) for k in range(level)))).where(F.col("path").isin(*known))
        else:
            rows = rows.withColumn("path", F.array().cast("array<int>"))
        cells: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        for r in rows.groupBy("path", grain.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
            cells.setdefault(tuple(r.path), []).append((r.cell, r.size, r.n))
        next_: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for path, (below, wanted) in open_.items():
            at, found = below, sorted(cells.get(path, []))
            bounds = []  # (bytes below, first cell of the upper side, rows of it)
            for cell, size, n in found:
                bounds.append((at, cell, n))
                at += size
            for b in wanted:
                target = total * b / shards
                near = min([(abs(x - target), (*path, cell)) for x, cell, _ in bounds] + [(abs(at - target), (*path, 1 << BITS))])
                x, cell, n = max((y for y in bounds if y[0] <= target), default=(at, 1 << BITS, 0))
                # finer cells of one row have no boundary between
                if near[0] <= slack or n <= 1 or level + 1 >= 3 * _ROUNDS:
                    done[b] = list(near[1])
                else:
                    deeper = next_.setdefault((*path, cell), (x, []))
                    deeper[1].append(b)
        open_, level = next_, level + 1
    return [done[b] for b in range(1, shards)]


def _above(splitter: list[int]) -> Column:
    """Whether a row's key is at or above a splitter: by its first rounds, as a comparison of whole paths."""
    path = F.array(*(_level(k) for k in range(len(splitter))))
    return path >= F.array(*map(F.lit, splitter))


def shard(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of its text plus 1), text_crc32 (unsigned; of no bytes if the text is
    null), shard (0 to shards - 1; their sums of sizes differ from a shard's share by `tolerance` of it and the largest
    text), slot (0, 1, ... within each shard). Equal texts share a shard unless a boundary has to cut them. Repeated
    rows and null doc_ids are placed like all others; rows that are alike may be told apart by a boundary or a slot, and
    either may come first. Empty tables give no rows; other columns are ignored."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    keyed = common.settled(keyed.withColumn("d", F.xxhash64("doc_id", "text_crc32", F.lit(1))).withColumn("p", F.xxhash64(F.monotonically_increasing_id())), "keys")
    found = splitters(keyed.select("h", "d", "p", "size"), shards, tolerance)
    placed = keyed.withColumn("shard", sum((F.when(_above(s), 1).otherwise(0) for s in found), F.lit(0)).cast("int"))

    n = keyed.count()
    pieces = max(1, min(1 << 20, n // CELL))
    unsigned = lambda c: (F.shiftrightunsigned(F.col(c), 11).cast("double") / float(1 << 53))
    placed = placed.withColumn("cell", F.floor(unsigned("h") * pieces).cast("int"))
    # at most n / (4 * CELL) cells are that large, and as many of their parts
    few = n // (4 * CELL) <= BROADCAST

    def parted(rows: DataFrame, by: list[str], hash_: str, name: str) -> DataFrame:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
        cut = sizes.where(F.col("n") > 4 * CELL).select(*by, F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
        return rows.join(F.broadcast(cut) if few else cut, by, "left").withColumn(name, F.floor(unsigned(hash_) * F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    cell = ["shard", "cell", "part", "slice"]
    parts = parted(parted(placed, cell[:2], "d", "part"), cell[:3], "p", "slice")
    counts = parts.groupBy(*cell).agg(F.count("*").alias("n"))
    before = counts.selectExpr(*cell, "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY cell, part, slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    ranked = parts.selectExpr("*", "row_number() OVER (PARTITION BY shard, cell, part, slice ORDER BY h, d, doc_id, size, text_crc32, p) - 1 AS place")
    joined = ranked.join(F.broadcast(before) if 2 * pieces + shards + 2 * (n // CELL) <= BROADCAST else before, cell)
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"))
