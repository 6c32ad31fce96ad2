"""Secret scans judged by how widely a candidate is owned across the corpus.

Candidates are found in each text by patterns: assignments to a secret's name, access keys, long hexadecimal strings,
and tokens of high entropy. Their hashes are aggregated over the whole corpus by distinct repositories and owners. A
value that COMMON owners or WIDE repositories or more hold is a widely copied example; one of fewer that looks random is
live. High entropy tokens that are no part of a match of the first three kinds become spans only if they are live.

Texts are read once; what travels is a hash for each candidate, first reduced to one row for each owner and repository.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Owners, and repositories of however few owners, from which a value counts as an example; bits a character from which
#: a value looks random.
COMMON, WIDE, ENTROPY = 3, 6, 3.0
#: Fixed order of kinds at the same start.
KINDS = ("assign", "access", "hex", "entropy")

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
#: Long runs of token characters; digits, lower and upper case are asked for afterwards.
_TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{20,}={0,2}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("random", T.BooleanType())]))
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("repository", T.StringType()), T.StructField("owner", T.StringType()), T.StructField("text_hash", T.LongType()), T.StructField("found", _SPAN)])


def entropy(value: bytes) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def candidates(text: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, first byte, byte after, secret value) of all candidates in a text, by start and kind."""
    out: list[tuple[str, int, int, bytes]] = []
    lower = text.translate(_LOWER)
    heads = []
    for name in _NAMES:
        at = lower.find(name)
        while at >= 0:
            heads.append(at)
            at = lower.find(name, at + 1)
    over = 0
    for at in sorted(heads):
        if at >= over and (m := _ASSIGN.match(text, at)):
            over = m.end()
            if len(m[2]) >= 8:
                out.append(("assign", m.start(), m.end(), m[2]))
    at = text.find(b"AKIA")
    while at >= 0:
        m = _ACCESS.match(text, at)
        if m and len(m[0]) >= 16:
            out.append(("access", m.start(), m.end(), m[0]))
        at = text.find(b"AKIA", m.end() if m else at + 1)
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    taken = sorted((a, z) for _, a, z, _ in out)
    for m in _TOKEN.finditer(text):
        v = m[0]
        if not (re.search(rb"[0-9]", v) and re.search(rb"[A-Za-z]", v)) or entropy(v) < ENTROPY:
            continue
        if not any(a < m.end() and m.start() < z for a, z in taken):
            out.append(("entropy", m.start(), m.end(), v))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _looks_random(value: bytes) -> bool:
    return entropy(value) >= ENTROPY and bool(re.search(rb"[0-9]", value)) and len(set(value)) >= 8


#: Bytes within a UTF-8 character; without them, one byte is left for each code point.
_TAIL = bytes(range(0x80, 0xC0))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())]))
    for batch in batches:
        found = []
        for text in batch.column(4).cast(pa.binary()).to_pylist():
            text = text or b""
            spans = []
            at = points = 0
            for kind, a, z, value in candidates(text):
                # code points from one span to the next, so that a text is counted once
                points += len(text[at:a].translate(None, _TAIL)) if a >= at else -len(text[a:at].translate(None, _TAIL))
                at = a
                spans.append({"kind": kind, "start": points, "end": points + len(text[a:z].translate(None, _TAIL)), "hash": hashlib.sha256(value).hexdigest(), "random": _looks_random(value)})
            found.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(found, schema)], names=FOUND.names)


def scan(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """Per document: doc_id, text_hash (xxhash64 of its text), base (spans of the three pattern kinds), spans (these and live tokens of high entropy), live
    (spans that are live), n_examples. A span is (kind, start, end) in code points, end exclusive, by start and then
    kind. repository and owner name string columns; where null, the document counts as its own unknown owner. Null texts
    count as empty and have no spans. Repeated rows give repeated results and count once in the corpus; other columns
    are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{repository}`").cast("string").alias("repository"), F.col(f"`{owner}`").cast("string").alias("owner"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = common.settled(rows.mapInArrow(_scan, FOUND), "candidates")
    full = found.where(F.size("found") > 0)
    single = full.select("repository", "owner", "doc_id", "text_hash", F.explode(F.array_distinct("found.hash")).alias("hash"))
    # one row for each value, owner and repository leaves a task; a value's rows are then as many as its owners at most
    held = single.groupBy("hash", F.coalesce("owner", F.concat(F.lit("?"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("owner"), F.coalesce("repository", F.lit("?")).alias("repository")).agg(F.count("*").alias("n"))
    owned = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    # the widely copied values are few, but the rows of one may be a third of all: n says how many
    examples = owned.where((F.col("owners") >= COMMON) | (F.col("repositories") >= WIDE)).select("hash", "n", F.lit(True).alias("example"))
    examples = common.settled(examples, "examples")
    each = full.select("doc_id", "text_hash", F.explode("found").alias("c")).select("doc_id", "text_hash", "c.*")
    total = found.agg(F.sum(F.size("found"))).first()[0] or 0
    judged = common.dealt_join(each, examples, ["hash"], "n", total, "left").distinct()
    judged = judged.withColumn("example", F.coalesce("example", F.lit(False))).withColumn("live", ~F.col("example") & F.col("random"))
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"), "kind", "end", "live", "example")
    by_doc = judged.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(span)).alias("all"))  # bounded by one text
    joined = found.select("doc_id", "text_hash").join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text_hash", F.coalesce("all", F.array().cast(by_doc.schema["all"].dataType)).alias("all"))
    plain = lambda keep: F.transform(F.filter("all", keep), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return joined.select("doc_id", "text_hash", plain(lambda s: s.kind != "entropy").alias("base"), plain(lambda s: (s.kind != "entropy") | s.live).alias("spans"), plain(lambda s: s.live).alias("live"), F.size(F.filter("all", lambda s: s.example)).cast("long").alias("n_examples"))


def spelled(spans: str) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def masked(docs: DataFrame, repository: str = "source", owner: str = "source", mask: str = "[secret]") -> DataFrame:
    """The documents with every live span of their texts replaced by a mask, n_chars as it then is, other columns as they
    are. Spans that overlap become one mask. Null and empty texts, and those without a live span, stay as they are; repeated
    rows are masked alike; rows without an id are masked by their text; an empty table gives none."""
    own, text_hash, spans = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "hash", "live"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    apart = lambda acc, s: F.concat(acc, F.array(F.struct(s.start.alias("start"), s.end.alias("end"))))
    wider = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc).start.alias("start"), F.greatest(last(acc).end, s.end).alias("end"))))
    merged = F.aggregate("live", none, lambda acc, s: F.when((F.size(acc) > 0) & (s.start < F.try_element_at(acc, F.lit(-1)).end), wider(acc, s)).otherwise(apart(acc, s)))
    live = common.settled(scan(docs, repository, owner).where(F.size("live") > 0).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash), merged.alias(spans)).distinct(), "live")
    joined = docs.join(common.small(live), F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    starts, ends = F.concat(F.array(F.lit(0).cast("long")), F.col(f"{spans}.end")), F.concat(F.col(f"{spans}.start"), F.array(F.length("text").cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, z: F.substring(F.col("text"), a.cast("int") + 1, (z - a).cast("int")))
    less = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s.end - s.start - len(mask))
    kept = F.col(spans).isNull()
    new = {"text": F.when(kept, F.col("text")).otherwise(F.array_join(pieces, mask)), "n_chars": F.when(kept, F.col("n_chars")).otherwise(F.length("text") - less).cast("long") if "n_chars" in docs.columns else None}
    return joined.select(*((new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in docs.columns))
