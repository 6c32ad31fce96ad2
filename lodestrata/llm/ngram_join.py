"""Self join of documents on the Jaccard similarity of their word n-gram sets, by prefix trees.

Equal sets are collapsed first and counted; one document stands for each set from there on, and the others are looked up
at the end, so groups of copies cost no pairs, no edges and no join on a hot key.

Sets are kept in one global order, that of their n-grams' hashes. Two sets of sizes a <= b that link differ in at most
D = (a + b) (100 - p) / (100 + p) n-grams. The order is cut into more than D arcs, and the sets are stored in a forest
with one tree for each arc: the path below the root of tree i is a set's n-grams of arc i. Two sets that link share the
whole path of some arc, so they meet in one node there. The forest's nodes are dealt out by the hash of their path, in
one shuffle; a set that meets others in a node within its task is known to share it, and needs no place beside them. A
set that shares too few nodes, such as those of a passage which many documents quote, can have no partner and is left
out. What stays is tied to the least set that stays in the node, and sets that are tied fall into one block.

A block is cut by the necessary prefixes of its sets, in the order of rarity within it (two sets that link share an n-gram
among the first of each), so that sets which only common n-grams tie don't meet. The sets of each part, two or many, are
stored in a trie, and each is joined by one traversal that shares the overlap of common paths and prunes subtrees by the
bounds on their sets' sizes and remaining lengths; the overlap at the node where a set ends is exact. Blocks of more than
CHUNK n-grams are cut into chunks and joined chunk by chunk, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

#: N-grams of one chunk of a block, forest entries that a task ties at once, and rows of block members, one for each chunk
#: of their block, to broadcast.
CHUNK, TIED, BROADCAST = 1 << 21, 2 << 20, 250_000
#: Sizes of one class differ by this factor at most; each class has its own arcs.
CLASS = 1.5
TABLE = common.fold_table(bytes([0x20, *range(0x09, 0x0E)]))

_U = np.uint64
SETS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_shingles", "f1", "f2")])


def max_difference(a: int, percent: int) -> int:
    """The most n-grams by which a set of a links with one that is as large or larger."""
    return (a + a * 100 // percent) * (100 - percent) // (100 + percent)


def arcs_of(most: int, largest: int) -> int:
    """Arcs for sets of up to `largest` n-grams that differ in at most `most`: one more than can differ, and spare ones,
    so that a set hardly ever has as many empty arcs as would have to be stored."""
    if not most:
        return 1
    empty = (most + 1) * float(np.exp(-largest / (most + 1)))
    return most + 1 + int(np.ceil(empty + 4 * empty**0.5 + 1))


def size_classes(largest: int) -> np.ndarray:
    """The least size of each class, up to the class of `largest`."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS)))
    return np.array(out, np.int64)


def n_gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's distinct n-grams in order. With fewer words than n, all of them make one; without words, none."""
    _, _, row, h = common.words(data, offsets, TABLE)
    rows = len(offsets) - 1
    values, at = common.shingles(h, row, n)
    sh_row = row[at]
    ends = np.searchsorted(sh_row, np.arange(rows + 1))
    word_ends = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for k in range(rows):
        own = values[ends[k] : ends[k + 1]]
        if len(own):
            own = np.sort(own)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif word_ends[k] < word_ends[k + 1]:
            few = h[word_ends[k] : word_ends[k + 1]]
            own = common.shingles(few, np.zeros(len(few), np.int64), len(few))[0]
        out.append(own)
    return out


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    return int(own.sum(dtype=_U).view(np.int64)), int(common.mixed(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64))


def tree_nodes(own: np.ndarray, percent: int, classes: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
    """The forest's nodes that hold a set: for its size's class, and those smaller ones in which it may have partners,
    the class, a hash for each arc that is not empty, and how many of these arcs can be left out. With a partner it
    shares arcs - difference whole arcs at least; left out may be fewer than these less the empty ones."""
    n = len(own)
    out = []
    top = int(np.searchsorted(classes, n, side="right")) - 1
    low = int(np.searchsorted(classes, -(-percent * n // 100), side="right")) - 1
    for c in range(low, top + 1):
        largest = int(classes[c + 1]) - 1
        of_class = _U((c + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        arcs = arcs_of(max_difference(largest, percent), largest)
        arc = ((own >> _U(32)) * _U(arcs)) >> _U(32)
        heads = np.flatnonzero(np.concatenate([[True], arc[1:] != arc[:-1]]))
        path = np.add.reduceat(common.mixed(own + _U(1)), heads)
        nodes = common.mixed(path + arc[heads] * _U(0x632BE59BD9B4E019) + of_class)
        own_most = max_difference(n, percent) if c == top else (largest + n) * (100 - percent) // (100 + percent)
        spare = len(heads) - own_most
        if spare <= 0:  # all shared arcs may be empty, so the empty ones are stored too
            empty = np.setdiff1d(np.arange(arcs, dtype=_U), arc[heads])
            nodes = np.concatenate([nodes, common.mixed(empty * _U(0x632BE59BD9B4E019) + of_class)])
        out.append((c, nodes, spare))
    return out


class Trie:
    """Sets in one order as a path-compressed trie over their sorted sequence; every node spans a range of it."""

    def __init__(self, sets: list[np.ndarray]):
        # the sequence: by the bytes of big-endian values, which order as the values do
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].byteswap().tobytes())
        self.sets = [sets[k] for k in self.order]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        m = len(self.sets)
        shared = [0] * (m + 1)
        for k in range(1, m):
            a, b = self.sets[k - 1], self.sets[k]
            z = min(len(a), len(b))
            unlike = np.flatnonzero(a[:z] != b[:z])
            shared[k] = int(unlike[0]) if len(unlike) else z
        # nodes: (depth of parent, own depth, first set, last set); a set's path ends in a node of its own length
        nodes: list[list[int]] = [[0, 0, 0, m - 1, -1]]
        stack = [0]
        for k in range(m):
            while nodes[stack[-1]][1] > shared[k]:
                done = stack.pop()
                nodes[done][3] = k - 1
                if nodes[stack[-1]][1] < shared[k]:  # a node of the depth at which set k leaves
                    nodes.append([nodes[stack[-1]][1], shared[k], nodes[done][2], k - 1, stack[-1]])
                    nodes[done][0], nodes[done][4] = shared[k], len(nodes) - 1
                    stack.append(len(nodes) - 1)
            nodes.append([nodes[stack[-1]][1], len(self.sets[k]), k, k, stack[-1]])
            stack.append(len(nodes) - 1)
        for done in stack:
            nodes[done][3] = m - 1
        table = np.array(nodes, np.int64)
        self.start, self.depth, self.first, self.last, parent = table.T
        by = np.argsort(parent, kind="stable")
        self.kids, self.kid_at = by, np.searchsorted(parent[by], np.arange(len(nodes) + 1))
        self.flat = np.concatenate(self.sets) if m else np.zeros(0, _U)
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        self.least = np.array([int(self.sizes[a : b + 1].min()) for a, b in zip(self.first, self.last, strict=True)], np.int64)
        self.most = np.array([int(self.sizes[a : b + 1].max()) for a, b in zip(self.first, self.last, strict=True)], np.int64)

    def partners(self, own: np.ndarray, percent: int, after: int = -1) -> np.ndarray:
        """Positions in the sequence, beyond `after`, of the sets that link with this one."""
        a = len(own)
        low, high = -(-percent * a // 100), a * 100 // percent
        node, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        found = []
        while len(node):
            n = self.kid_at[node + 1] - self.kid_at[node]
            if not n.sum():
                break
            at = np.repeat(self.kid_at[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            node, overlap = self.kids[at], np.repeat(overlap, n)
            keep = (self.last[node] > after) & (self.most[node] >= low) & (self.least[node] <= high)
            node, overlap = node[keep], overlap[keep]
            if not len(node):
                break
            length = self.depth[node] - self.start[node]
            ends = np.cumsum(length)
            left = a * np.ones(len(node), np.int64)
            if ends[-1]:
                tokens = self.flat[np.repeat(self.base[self.first[node]] + self.start[node] - np.concatenate([[0], ends[:-1]]), length) + np.arange(int(ends[-1]))]
                place = np.searchsorted(own, tokens)
                hit = np.concatenate([[0], np.cumsum(own[np.minimum(place, a - 1)] == tokens)])
                overlap = overlap + hit[ends] - hit[ends - length]
                some = length > 0
                left[some] = a - np.searchsorted(own, tokens[ends[some] - 1], side="right")
            sizes = np.clip(self.most[node], low, high)
            bound = overlap + np.minimum(left, sizes - self.depth[node])
            need = -(-percent * (a + np.clip(self.least[node], low, high)) // (100 + percent))
            # a set ends in a leaf, or in an inner node where it is a prefix of the sets below
            ends_here = (self.depth[node] == self.sizes[self.first[node]]) & (self.first[node] > after)
            k, o = self.first[node[ends_here]], overlap[ends_here]
            found.append(k[(100 + percent) * o >= percent * (a + self.sizes[k])])
            keep = (self.first[node] < self.last[node]) & (bound >= need)
            node, overlap = node[keep], overlap[keep]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def parts(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """The sets in parts that no link leaves. Two sets that link share an n-gram among the first of each, under any order
    that both follow; here it is that of rarity within the block, so common n-grams hardly ever tie sets together."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    head = np.concatenate([[True], flat[by][1:] != flat[by][:-1]])
    rank = np.cumsum(head) - 1
    token = np.empty(len(flat), np.int64)
    token[by] = rank
    often = np.bincount(rank)[token]
    order = np.lexsort((token, often, owner))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(first, sizes)
    prefix = order[place < np.repeat(sizes + (-percent * sizes) // 100 + 1, sizes)]
    prefix = prefix[often[prefix] > 1]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    prefix = prefix[np.argsort(token[prefix], kind="stable")]
    same = token[prefix][1:] == token[prefix][:-1]
    for a, b in zip(owner[prefix][:-1][same].tolist(), owner[prefix][1:][same].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    found: dict[int, list[int]] = {}
    for k in range(len(sets)):
        found.setdefault(find(k), []).append(k)
    return list(found.values())


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """All pairs of distinct sets that link."""
    return [(own[i], own[j]) for own in parts(sets, percent) if len(own) > 1 for i, j in _part_links([sets[k] for k in own], percent)]


def _part_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    trie = Trie(sets)
    return [(trie.order[k], trie.order[int(j)]) for k, own in enumerate(trie.sets) for j in trie.partners(own, percent, k)]


def _forest(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, node, id, set, form, spare, met): a set in a node; set is a hash of it. Where a task sees several sets in a
    node, all are known to have met; all but the least get keys of their own, so that a node's rows are one for each task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_: list[tuple[np.ndarray, int, int, int, int]] = []
        classes = size_classes(1024)

        def flush() -> pa.RecordBatch:
            length = np.array([len(x[0]) for x in parts_])
            node = np.concatenate([x[0] for x in parts_])
            own, form, spare, same = (np.repeat(np.array([x[k] for x in parts_], np.int64), length) for k in (1, 2, 3, 4))
            by = np.lexsort((own, node))
            node, own, form, spare, same = node[by], own[by], form[by], spare[by], same[by]
            head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            many = np.diff(np.concatenate([head, [len(node)]]))
            met = np.repeat(np.minimum.reduceat(same, head) != np.maximum.reduceat(same, head), many)
            is_head = np.zeros(len(node), bool)
            is_head[head] = True
            key = np.where(met & ~is_head, common.mixed(own.astype(_U) * _U(31) + node), node)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node.view(np.int64)), pa.array(own), pa.array(same), pa.array(form.astype(np.int16)), pa.array(spare.astype(np.int32)), pa.array(met)], names=["key", "node", "id", "set", "form", "spare", "met"])

        held = 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in common.text_slices(batch.column(1)):
                for k, own in enumerate(n_gram_sets(data, offsets, n)):
                    if not len(own):
                        continue
                    if len(own) >= classes[-1]:
                        classes = size_classes(len(own) * 2)
                    for form, nodes, spare in tree_nodes(own, percent, classes):
                        parts_.append((nodes, int(doc[first + k]), form, spare, fingerprint(own)[1]))
                        held += len(nodes)
                    if held >= TIED:
                        yield flush()
                        parts_, held = [], 0
        if parts_:
            yield flush()

    return rows.mapInArrow(emit, "key long, node long, id long, set long, form short, spare int, met boolean")


def _meetings(forest: DataFrame) -> DataFrame:
    """(u, v): sets that may link are tied together through these. A set that shares fewer nodes with any others than it
    can spare is left out: with a partner it would share more. Shared or not is the same for both partners, so what both
    must keep stays. Of what stays, a set needs no more of its shared nodes, the rarest first, than all but as many as it
    must share with a partner, less one: the rarest node that two partners share is among these of both. So what many
    documents quote ties only sets that have nothing rarer. In these nodes, sets are tied to the least of them."""
    met = forest.selectExpr("node", "id", "form", "spare", "met OR min(set) OVER (PARTITION BY key) <> max(set) OVER (PARTITION BY key) AS met").where("met")
    kept = met.selectExpr("node", "id", "form", "spare", "count(*) OVER (PARTITION BY id, form) AS shared").where("shared >= spare").drop("shared")
    kept = common.settled(kept, "kept")
    often = common.settled(kept.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").withColumn("often", F.col("n")), "often")
    several = common.dealt_join(kept, often, ["node"], "n", kept.count())
    ranked = several.selectExpr("node", "id", "spare", "count(*) OVER (PARTITION BY id, form) AS shared", "row_number() OVER (PARTITION BY id, form ORDER BY often, node) AS place")
    rare = common.settled(ranked.where("place <= shared - greatest(spare, 1) + 1").select("node", "id"), "rare")
    least = common.settled(rare.groupBy("node").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1"), "least")
    return common.dealt_join(rare, least, ["node"], "n", rare.count()).where("id <> v").select(F.col("id").alias("u"), "v").distinct()


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set of n-word shingles), n_links (documents it links with),
    component_id (the least doc_id that links reach, itself included). Documents link when
    100 * |intersection| >= percent * |union|. Null or word-less texts have an empty set and no links. With fewer than
    n words the whole sequence is one shingle. Rows that share a doc_id count as one node; a null doc_id gives a null
    component and no links. Other columns are ignored."""
    spark = docs.sparkSession
    rows = common.wanted(docs, doc_id="long", text="string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, f1, f2 = [], [], []
            for _, data, offsets in common.text_slices(batch.column(1)):
                for own in n_gram_sets(data, offsets, n):
                    a, b = fingerprint(own) if len(own) else (0, 0)
                    size.append(len(own)), f1.append(a), f2.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], names=["doc_id", "n_shingles", "f1", "f2"])

    measured = common.settled(rows.mapInArrow(measure, SETS), "sets")
    key = ["n_shingles", "f1", "f2"]
    some = measured.where("n_shingles > 0 AND doc_id IS NOT NULL")
    n_some = some.count()
    classes = common.settled(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    several = classes.where("copies > 1").withColumn("n", F.col("copies"))
    copies = common.settled(common.dealt_join(some, several, key, "n", n_some).where("doc_id <> rep").select("doc_id", "rep"), "copies")

    # rows that share an id, with texts that differ, count as one
    several_sets = some.select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id")
    same_id = some.join(several_sets, "doc_id", "left_semi").select("doc_id", *key).distinct()
    aliases = common.settled(same_id.join(classes, key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v"), "aliases")

    first = rows.where("doc_id IS NOT NULL").join(common.small(copies.select("doc_id").distinct()), "doc_id", "left_anti")
    first = first if not aliases.limit(1).count() else rows.where("doc_id IS NOT NULL")  # an id may stand for one set and be a copy of another
    blocks = components(_meetings(_forest(first, n, percent)).unionByName(aliases), "blocks")

    # only one document of each set goes on
    members = classes.join(blocks, F.col("rep") == F.col("id")).select("rep", *key, "copies", F.col("root").alias("block"))
    members = common.settled(members, "members")
    weight = members.groupBy("block").agg(F.count("*").alias("m"), F.ceil(F.sum("n_shingles") / CHUNK).alias("chunks")).where("m > 1")
    members = members.join(weight, "block").withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks")).drop("m")
    members = common.settled(members, "members")
    most, dealt_rows = members.agg(F.max("chunks"), F.sum("chunks")).first()
    split = (most or 1) > 1

    few = (dealt_rows or 0) <= BROADCAST  # a member has a row for each chunk of its block
    part = members.select("rep", "f1", "f2", "copies", "block", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    part = part.select("rep", "f1", "f2", "copies", "block", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    texts = rows.join(F.broadcast(part) if few else part, F.col("doc_id") == F.col("rep")).select("block", "i", "j", "chunk", "doc_id", "copies", "f1", "f2", "text")
    dealt = texts.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        at: tuple | None = None

        def joined() -> pa.RecordBatch:
            ids, sets, chunks, weights = (list(x) for x in zip(*held.values(), strict=True))
            links = np.zeros(len(ids), np.int64)
            root = list(range(len(ids)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for x, y in block_links(sets, percent) if len(sets) > 1 else []:
                if at[1] == at[2] or chunks[x] != chunks[y]:
                    links[x] += weights[y]
                    links[y] += weights[x]
                    a, b = find(x), find(y)
                    if a != b:
                        a, b = (a, b) if ids[a] < ids[b] else (b, a)
                        root[b] = a
            full = [k for k in range(len(ids)) if links[k]]
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in full], pa.int64()), pa.array([ids[find(k)] for k in full], pa.int64()), pa.array(links[full], pa.int64())], names=["u", "v", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            chunk, doc, weight, f1, f2 = (batch.column(k).to_pylist() for k in (3, 4, 5, 6, 7))
            for first, data, offsets in common.text_slices(batch.column(8)):
                for k, own in enumerate(n_gram_sets(data, offsets, n), first):
                    if keys[k] != at:
                        if held:
                            yield joined()
                        held, at = {}, keys[k]
                    if len(own) and fingerprint(own) == (f1[k], f2[k]):  # else another text under the same id
                        held.setdefault((f1[k], f2[k]), (doc[k], own, chunk[k], weight[k]))
        if held:
            yield joined()

    linked = common.settled(dealt.mapInArrow(join_blocks, "u long, v long, links long"), "links")
    counted = linked.groupBy("u").agg(F.sum("links").alias("links"))
    # a block in one piece is done; only cut blocks, or ids of several sets, need their pieces tied together
    if split or aliases.limit(1).count():
        roots = components(linked.select("u", "v").unionByName(aliases), "final").withColumnRenamed("id", "u")
    else:
        roots = linked.select("u", F.col("v").alias("root")).distinct()
    told = classes.join(roots.join(counted, "u", "full").select(F.col("u").alias("rep"), "root", "links"), "rep", "left")
    told = common.settled(told.select(*key, F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "copies"), "told")
    done = common.dealt_join(some, told, key, "copies", n_some).select("doc_id", "n_shingles", F.col("links").cast("long").alias("n_links"), F.col("root").alias("component_id"))
    # what has no n-grams, or no id, links with nothing; an id with other rows that do is still one node
    rest = measured.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links"))
    known = done.select("doc_id", "component_id").where("component_id <> doc_id").distinct()
    return done.unionByName(rest.join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")).select(*done.columns))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the least doc_id of their component, with their columns; rows that share a
    doc_id stay or go together, and rows without one stay."""
    gone = common.settled(ngram_join(docs, n, percent).where("component_id <> doc_id").select("doc_id"), "gone")
    return docs.join(common.small(gone), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
