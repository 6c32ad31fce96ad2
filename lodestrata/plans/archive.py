"""Archives as tables: entries, bodies or chunks and recipes, as Parquet under one folder, and a small file for each batch.

A pack or an append writes its tables under a name of its own attempt; they belong to the archive from the moment on in
which the batch's file in `meta` names them, and nothing else is ever read. Packing writes beside the archive and moves
it into place; appending adds files and changes none. Listing reads the entries alone. Rows are ranged by the solid order
before they are written, so like entries lie together for the codec. Bodies are in pieces of bounded size.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, digests, fixed, scalars, settings
from ..functions.messages import Messages
from ..functions.settings import Options
from ..operators import chunking, compare, dedup, heuristics, inventory, ordering, selectors
from ..sources import manifest
from .storage import BROADCAST, dropped, file_system, settled

ENTRY = ["rel", "kind", "mode", "size", "mtime", "link_target", "hash_algo", "hash", "bucket", "pieces", "xattrs"]
#: What `meta` says it is, and the digests that may be stored.
FORMAT = "lodestrata archive 2"
HASHES = (None, "crc32", "xxh3", "blake3")


# --- files ---


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def _move(spark: SparkSession, made: str, path: str) -> None:
    fs, at = file_system(spark, path)
    _, source = file_system(spark, made)
    fs.mkdirs(at.getParent())
    if not fs.rename(source, at):
        raise OSError(f"can't move {made} to {path}")


def _publish(spark: SparkSession, made: str, path: str) -> None:
    """Move a finished folder into place. What is there is moved aside first and deleted last, so that a run that ends in
    between leaves both."""
    aside = f"{path}.old-{uuid.uuid4().hex}" if _exists(spark, path) else None
    if aside:
        _move(spark, path, aside)
    try:
        _move(spark, made, path)
    except Exception:
        if aside:
            _move(spark, aside, path)
        raise
    if aside:
        dropped(spark, aside)


def _commit(spark: SparkSession, path: str, first: int, known: dict) -> int:
    """Write a batch's file under the first free number from `first` on. A number is taken by a file that only one writer
    can create; the batch's own file then appears whole, by a rename."""
    n = first
    while True:
        fs, lock = file_system(spark, f"{path}/meta/batch-{n:06d}.taken")
        try:
            fs.create(lock, False).close()
            break
        except Py4JJavaError as e:
            if not fs.exists(lock):
                raise e
            n += 1
    _, part = file_system(spark, f"{path}/meta/batch-{n:06d}.part-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(known | {"batch": n}).encode()))
    out.close()
    _, at = file_system(spark, f"{path}/meta/batch-{n:06d}.json")
    if not fs.rename(part, at):
        raise OSError(f"can't write {at}")
    return n


def roots(spark: SparkSession, path: str) -> list[str]:
    """The folders of an archive: path itself, else the parts path.001, path.002 and so on."""
    if _exists(spark, f"{path}/meta"):
        return [path]
    found: list[str] = []
    while _exists(spark, part := f"{path}.{len(found) + 1:03d}"):
        found.append(part)
    if not found:
        raise FileNotFoundError(path)
    return found


def batches(spark: SparkSession, path: str) -> list[dict]:
    """What `meta` says of each batch, in order: settings, attempt, summary and token. Another format, or settings that
    are not known, are errors."""
    root = roots(spark, path)[0]
    fs, at = file_system(spark, f"{root}/meta")
    names = [str(s.getPath()) for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [json.loads(r.value) for r in spark.read.text([n for n in names if n.endswith(".json")], wholetext=True).collect()] if any(n.endswith(".json") for n in names) else []
    if not found:
        raise ValueError(f"no archive: {path}")
    for b in found:
        if b.get("format") != FORMAT:
            raise ValueError(f"{path} has another format: {b.get('format')!r}")
        if b["backend"] not in ("zstd", "lzma") or b["hash_algo"] not in HASHES or b["preproc"] not in ("none", "rep", "srep"):
            raise ValueError(f"{path} has settings that are not known: {b['backend']}, {b['hash_algo']}, {b['preproc']}")
    return sorted(found, key=lambda b: b["batch"])


def meta(spark: SparkSession, path: str) -> dict:
    """The settings that the archive was made with."""
    return batches(spark, path)[0]


def _dictionary(known: dict) -> bytes | None:
    return base64.b64decode(known["dictionary"]) if known.get("dictionary") else None


# --- writing ---


def _images(entries: DataFrame) -> DataFrame:
    """The entries with `image`: the body of a recompressed JPEG or PNG where there is a recompressor and it succeeds; not
    for bodies of several pieces."""
    image = F.lit(None).cast("binary")
    for kind, (encode, _) in codecs.RECOMPRESSORS.items():
        image = F.when((F.col("pieces") == 1) & (scalars.sniffed(F.col("body")) == kind.capitalize()), codecs.applied(F.col("body"), codecs.attempted(encode))).otherwise(image)
    return entries.withColumn("image", image)


def trained(placed: DataFrame) -> bytes | None:
    """A zstd dictionary from the heads of entries in solid order, which are at most 16 MiB together."""
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).select(scalars.dictionary_size(F.col("n")).alias("n")).first().n
    sample = ordering.sampled(placed.drop("body")).select("position", "head").join(placed.select("position", "body"), "position")
    return codecs.trained_dictionary([bytes(r.b) for r in sample.select(F.expr("substring(body, 1, cast(head AS int))").alias("b")).collect()], total)


def _laid(entries: DataFrame) -> DataFrame:
    """The entries' rows, a row for each piece of a body, in solid order with their positions, written once."""
    names = entries.columns
    rows = entries
    if "piece" not in names:  # bodies that were not read by the manifest are of one piece
        rows = rows.withColumn("piece", F.lit(0)).withColumn("pieces", F.lit(1)).withColumn("sha256", F.unhex(F.sha2("body", 256)))
    if "xattrs" not in names:
        rows = rows.withColumn("xattrs", F.array())
    rows = rows.select(
        "full", F.translate("rel", "\\", "/").alias("rel"), "kind", "is_regular", F.col("size").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"), F.col("mode").cast("long").alias("mode"),
        F.coalesce("link_target", F.lit("")).alias("link_target"), F.col("xattrs").cast("array<struct<name:binary,value:binary>>").alias("xattrs"), "ext", "piece", "pieces", "sha256", F.substring("body", 1, heuristics.HEAD).alias("first"), F.col("body").isNull().alias("bodiless"), "body",
    )
    return ordering.numbered(_images(rows), [*ordering.solid_key(), F.col("piece")], "position")


def _trailers(pieces: DataFrame, keys: list[str], algo: str) -> DataFrame:
    """length and hash (in its stored form) of bodies by their keys. Those of one piece are hashed where they are; the pieces
    of larger ones meet in one task, in order, and go through a running digest."""
    one = pieces.where("pieces = 1").select(*keys, F.octet_length("body").cast("long").alias("length"), digests.trailer(F.col("body"), algo).alias("hash"), F.crc32("body").alias("crc32"), F.when(F.col("body").isNull(), 0).otherwise(1).alias("found"))
    more = pieces.where("pieces > 1").select(*keys, "piece", "body").repartition(*keys).sortWithinPartitions(*keys, "piece")
    shape = one.schema

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, crc, n, found = None, None, None, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(at, types, strict=True)), pa.array([n], pa.int64()), pa.array([state.digest()], pa.binary()), pa.array([int.from_bytes(crc.digest(), "little")], pa.int64()), pa.array([found], pa.int32())], names=shape.names)

        types = None
        for batch in batches_:
            types = [batch.column(k).type for k in range(len(keys))]
            for *key, body in zip(*(batch.column(k).to_pylist() for k in (*range(len(keys)), len(keys) + 1)), strict=True):
                if key != at:
                    if at is not None:
                        yield row()
                    at, state, crc, n, found = key, digests.Streamed(algo), digests.Streamed("crc32"), 0, 0
                if body is not None:
                    state.update(body)
                    crc.update(body)
                    n, found = n + len(body), found + 1
        if at is not None:
            yield row()

    return one.unionByName(more.mapInArrow(run, shape))


def _write(spark: SparkSession, laid: DataFrame, path: str, attempt: str, options: Options, known: dict) -> dict:
    """Write the tables of one attempt; how many entries, bytes and stored bytes there are."""
    hash_algo, codec = known["hash_algo"], known["backend"]
    files = laid.where("piece = 0")
    bad = files.where("is_regular AND bodiless").select("full").limit(1).first()
    if bad:
        raise ValueError(f"can't be read: {bad.full}, and maybe others")
    if options.route:
        whole = files.where("is_regular").agg(F.sum(F.when(ordering.stored_as_is(), F.col("size")).otherwise(0)).alias("media"), F.sum("size").alias("size")).first()
        gated = bool(whole["size"]) and whole["media"] / whole["size"] >= ordering.GATE
        laid = laid.withColumn("bucket", F.when(ordering.stored_as_is() & F.lit(gated), "media").otherwise("default"))
    else:
        laid = laid.withColumn("bucket", F.lit("default"))
    files = laid.where("piece = 0")
    dups = settled(dedup.duplicates(files, F.col("sha256"), "bucket").select("full", "canonical_rel"), "duplicates")
    dups = F.broadcast(dups) if dups.limit(BROADCAST + 1).count() <= BROADCAST else dups

    is_link = F.col("canonical_rel").isNotNull()
    cut = F.lit(options.chunked) & F.col("is_regular") & (F.col("size") > 0) & (F.col("pieces") == 1)
    kind = F.when(is_link, 3).when(F.col("image").isNotNull(), F.when(scalars.sniffed(F.col("first")) == "Jpeg", 5).otherwise(6)).when(cut, 4).otherwise(F.col("kind"))
    kinds = laid.join(dups, "full", "left").withColumn("kind", kind)
    has_body = kinds.where("kind IN (0, 4, 5, 6) AND is_regular")

    entry = kinds.where("piece = 0").select("position", "rel", "kind", "mode", F.when(is_link, 0).otherwise(F.col("size")).alias("size"), "mtime", F.when(is_link, F.col("canonical_rel")).otherwise(F.col("link_target")).alias("link_target"), F.lit(hash_algo).cast("string").alias("hash_algo"), "bucket", "pieces", "xattrs")
    if hash_algo:
        stored_hash = _trailers(has_body.select("rel", "piece", "pieces", "body"), ["rel"], hash_algo).select("rel", "hash")
        entry = entry.join(stored_hash, "rel", "left")
    else:
        entry = entry.withColumn("hash", F.lit(None).cast("binary"))
    seen = Observation()
    entry.select("position", *ENTRY).observe(seen, F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("kind") == 5).alias("jpeg"), F.count_if(F.col("kind") == 6).alias("png")).write.parquet(f"{path}/entries/{attempt}")

    body = F.coalesce("image", "body")
    before = f"delta{options.delta}" if options.delta else "lzp" if options.lzp else known["preproc"] if known["preproc"] != "none" else None
    ready = codecs.filtered(body, before) if before else body
    coded = lambda c: codecs.encoded(ready, c, options.level, known["branch"], _dictionary(known), options.long, known["knobs"])
    stored = lambda df, c: df.select("position", "rel", "kind", "piece", "pieces", F.lit(c).alias("codec"), coded(c).alias("body"))
    plain = has_body.where("kind <> 4")
    own = "store" if options.store else codec
    out = stored(plain.where("bucket <> 'media'"), own)
    if options.route:
        out = out.unionByName(stored(plain.where("bucket = 'media'"), "store"))
    counted = Observation()
    out.observe(counted, F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("stored")).write.parquet(f"{path}/bodies/{attempt}")
    if options.chunked:
        # ids are of one pack; a chunked archive takes no more
        chunks = settled(chunking.chunked(has_body.where("kind = 4")), "chunks")
        ids = chunking.registry(chunks).withColumn("payload", codecs.encoded(F.col("payload"), own, options.level, known["branch"], _dictionary(known), False, known["knobs"]))
        ids.write.parquet(f"{path}/chunks/{attempt}")
        chunking.recipes(chunks, spark.read.parquet(f"{path}/chunks/{attempt}").drop("payload")).write.parquet(f"{path}/recipes/{attempt}")
    return seen.get | counted.get


def pack(entries: DataFrame, path: str, options: Options | None = None, hash_algo: str | None = "crc32", comment: str = "", selection: selectors.Selection | None = None, dictionary: bool = False, done: Callable[[str, str], None] | None = None, messages: Messages | None = None) -> dict:
    """Write a new archive of entries with bodies (full, rel, kind, is_regular, size, mtime, mode, link_target, ext, body;
    and the columns of with_bodies(), if large files are in pieces), in place of what is there. Rows pass the selection
    first. xxh3 and blake3 are other digests; None is none. A dictionary is trained for zstd if asked for. A regular file
    without a body, since it couldn't be read, is an error. With options.split the archive is in parts, path.001 and so on.
    done(path, status) is called on the driver at the end, with ok or failed. The counters of the run: entries, bytes,
    stored bytes, images, parts."""
    try:
        counters = _pack(entries, path, options, hash_algo, comment, selection, dictionary, messages or Messages())
    except Exception:
        if done:
            done(path, "failed")
        raise
    if done:
        done(path, "ok")
    return counters


def _pack(entries: DataFrame, path: str, options: Options | None, hash_algo: str | None, comment: str, selection: selectors.Selection | None, dictionary: bool, messages: Messages) -> dict:
    options = settings.checked(options or Options())
    if options.append or options.stdout:
        raise ValueError("not supported: append() adds to an archive; archives are folders, so none goes to a pipe")
    if hash_algo not in HASHES:
        raise ValueError(f"unknown hash: {hash_algo!r}")
    codec = settings.backend(options)
    if codec == "ppmd":
        raise ValueError("codec not available: ppmd")
    spark = entries.sparkSession
    laid = _laid(selectors.select(entries, selection) if selection else entries)
    files = laid.where("piece = 0")
    summary = inventory.scan_summary(files).first().asDict(True)
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    settings.checked(options, total)
    branch = None
    if codec == "lzma":
        found = heuristics.executable(files.drop("body").withColumnRenamed("first", "body")).first().branch if options.branch == "auto" else options.branch
        branch = None if found == "none" else settings.branch_filter(found)
    elif options.branch not in ("auto", "none"):
        messages.warning(f"zstd has no branch filter, so {options.branch} is left out")
    words = trained(laid.where("pieces = 1")) if dictionary and codec == "zstd" else None
    if dictionary and codec != "zstd":
        messages.warning("a dictionary is of use for zstd alone, so none is trained")
    known = asdict(options) | {"format": FORMAT, "backend": codec, "hash_algo": hash_algo, "comment": comment, "preproc": settings.preproc(options, total), "branch": branch, "knobs": settings.knobs(spark.conf.get), "dictionary": base64.b64encode(words).decode() if words else None}
    made, attempt = f"{path}.tmp-{uuid.uuid4().hex}", uuid.uuid4().hex
    counters = _write(spark, laid, made, attempt, options, known)
    _commit(spark, made, 0, known | {"attempt": attempt, "summary": summary, "token": None})
    if not options.split:
        _publish(spark, made, path)
        _without_parts(spark, path, 0)
        return counters | {"parts": 1}
    parts = _cut(spark, made, attempt, options.split)
    for k in reversed(range(1, parts + 1)):  # the first, without which there is no archive, comes last
        _publish(spark, f"{made}.{k:03d}", f"{path}.{k:03d}")
    _without_parts(spark, path, parts)
    if _exists(spark, path):
        dropped(spark, path)
    return counters | {"parts": parts}


def _without_parts(spark: SparkSession, path: str, kept: int) -> None:
    """Delete the parts beyond the first `kept`, of an archive that was there before."""
    k = kept + 1
    while _exists(spark, part := f"{path}.{k:03d}"):
        dropped(spark, part)
        k += 1


def _cut(spark: SparkSession, made: str, attempt: str, limit: int) -> int:
    """Deal the stored bodies out to parts, in solid order: a part ends with the body that takes it beyond the limit. The
    first part has the entries and `meta` too. The number of parts."""
    bodies_ = spark.read.parquet(f"{made}/bodies/{attempt}")
    parts = settled(ordering.split_parts(bodies_.select("position", F.octet_length("body").cast("long").alias("size")), limit), "split")
    numbers = sorted(r.part for r in parts.select("part").distinct().collect())
    bodies_.join(parts.select("position", "part"), "position").repartition("part").write.partitionBy("part").parquet(f"{made}/split")
    dropped(spark, f"{made}/bodies")
    for k in numbers[1:]:
        _move(spark, f"{made}/split/part={k}", f"{made}.{k:03d}/bodies/{attempt}")
    if numbers:
        _move(spark, f"{made}/split/part=1", f"{made}/bodies/{attempt}")
        dropped(spark, f"{made}/split")
    _move(spark, made, f"{made}.001")
    return max(1, len(numbers))


def append(entries: DataFrame, path: str, token: str | None = None) -> int:
    """Add entries as a batch of their own, with the archive's settings; duplicates are looked for within the batch. The
    number of the batch; what is there stays as it is. A token names the work, so that the same one is done once."""
    spark = entries.sparkSession
    before = batches(spark, path)
    if len(roots(spark, path)) > 1:
        raise ValueError("can't append to an archive with split")
    for b in before:
        if token is not None and b["token"] == token:
            return b["batch"]
    known = settings.append_checked(before[0])
    options = Options(**{k: v for k, v in known.items() if k in Options.__dataclass_fields__})
    laid, attempt = _laid(entries), uuid.uuid4().hex
    _write(spark, laid, path, attempt, options, known)
    summary = inventory.scan_summary(laid.where("piece = 0")).first().asDict(True)
    return _commit(spark, path, before[-1]["batch"] + 1, known | {"attempt": attempt, "summary": summary, "token": token})


# --- reading ---


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of all batches that `meta` names, from all parts, with the number of the batch."""
    found = None
    for b in batches(spark, path):
        places = [p for root in roots(spark, path) if _exists(spark, p := f"{root}/{name}/{b['attempt']}")]
        if places:
            own = spark.read.parquet(*places).withColumn("batch", F.lit(b["batch"]))
            found = own if found is None else found.unionByName(own)
    return found


def entries(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "entries")


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """rel, batch, piece, pieces and body of every entry that has one, as it was. A body whose piece, or whose chunk, is
    missing in the archive has a null there."""
    known = meta(spark, path)
    words = _dictionary(known)
    stored = _table(spark, path, "bodies")
    read = lambda codec: stored.where(F.col("codec") == codec).select("rel", "batch", "kind", "piece", "pieces", codecs.decoded(F.col("body"), codec, words).alias("body"))
    plain = read("store").unionByName(read(known["backend"]))
    before = f"delta{known['delta']}" if known["delta"] else "lzp" if known["lzp"] else known["preproc"]
    if before != "none":
        plain = plain.withColumn("body", codecs.unfiltered(F.col("body"), before))
    for kind, (_, decode) in codecs.RECOMPRESSORS.items():
        number = fixed.ENTRY_KINDS[kind]
        plain = plain.where(F.col("kind") != number).unionByName(plain.where(F.col("kind") == number).withColumn("body", codecs.applied(F.col("body"), decode)))
    plain = plain.drop("kind")
    if known["chunked"]:
        ids = _table(spark, path, "chunks").withColumn("payload", codecs.decoded(F.col("payload"), "store" if known["store"] else known["backend"], words))
        whole = chunking.reassembled(_table(spark, path, "recipes"), ids)
        plain = plain.unionByName(whole.select(F.col("path").alias("rel"), F.lit(0).alias("batch"), F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "body"))
    return plain


def listing(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    return selectors.find(entries(spark, path), terms or [])


def totals(spark: SparkSession, path: str) -> DataFrame:
    """As inventory.archive_totals, with the bytes of stored bodies and chunks."""
    stored = _table(spark, path, "bodies").groupBy("rel", "batch").agg(F.sum(F.octet_length("body")).alias("stored_size"))
    rows = entries(spark, path).join(stored, ["rel", "batch"], "left").select("kind", "size", "stored_size")
    if meta(spark, path)["chunked"]:
        rows = rows.unionByName(_table(spark, path, "chunks").select(F.lit(4).alias("kind"), F.lit(0).cast("long").alias("size"), F.octet_length("payload").cast("long").alias("stored_size")))
        every = inventory.archive_totals(rows)
        return every.withColumn("files", F.lit(entries(spark, path).where(scalars.file_like(F.col("kind"))).count()))
    return inventory.archive_totals(rows)


def _seen(spark: SparkSession, path: str) -> DataFrame:
    """Every entry with the digests of the body that the archive gives (null without one) and `same`: whether it has the
    length and digest that were stored. Bodies are hashed where they lie; what is joined are digests."""
    algo = meta(spark, path)["hash_algo"]
    read = _trailers(bodies(spark, path), ["rel", "batch"], algo or "crc32").select("rel", "batch", "length", F.col("hash").alias("read_hash"), "crc32", "found")
    joined = entries(spark, path).join(read, ["rel", "batch"], "left")
    same = (F.col("length") == F.col("size")) & (F.col("found") == F.col("pieces")) & (F.lit(True) if algo is None else F.col("read_hash") == F.col("hash"))
    return joined.withColumn("same", F.coalesce(same, F.lit(False)))


def checked(spark: SparkSession, path: str) -> DataFrame:
    """rel, kind, size and ok of every entry: whether its body has the length and digest that were stored; null where
    nothing was stored to check, and for a body that is missing, false."""
    return _seen(spark, path).select("rel", "kind", "size", F.when(scalars.file_like(F.col("kind")), F.col("same")).alias("ok"))


def test(spark: SparkSession, path: str) -> DataFrame:
    return inventory.test_tally(checked(spark, path))


def verify(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """rel and status of every entry against the files below a folder, in which the entries' paths begin: miss, diff or ok,
    as compare.verify. A damaged or missing body in the archive is a diff."""
    live = manifest.fingerprints(spark, folder)
    stored = _seen(spark, path).select("rel", "kind", "size", F.when(F.col("same"), F.col("crc32")).alias("crc32"), F.lit(None).cast("long").alias("stored_crc32"))
    return compare.verify(stored, live)


def safe(rel: Column) -> Column:
    """Whether a path stays below a folder: not absolute, without '..'."""
    return ~F.startswith(rel, F.lit("/")) & ~F.array_contains(F.split(rel, "/"), "..")


def extract(spark: SparkSession, path: str, dest: str) -> int:
    """Write all entries below a folder that all executors share; the number of entries. An unsafe path is an error
    before anything is written, and a body that the archive doesn't have whole is one too. Folders and files come first,
    then links, so that every target is there; last, folders get their modes and times."""
    every = entries(spark, path)
    bad = every.where(~safe(F.col("rel"))).select("rel").first()
    if bad:
        raise ValueError(f"unsafe path: {bad.rel}")

    def restore(target: str, row: dict) -> None:
        for x in row["xattrs"] or []:
            try:
                os.setxattr(target, bytes(x["name"]), bytes(x["value"]))
            except (AttributeError, OSError):
                pass  # as far as it goes
        try:
            if row["mode"] is not None:
                os.chmod(target, row["mode"])
            if row["mtime"] is not None:
                os.utime(target, (row["mtime"], row["mtime"]))
        except OSError:
            pass  # as far as it goes

    def each(df: DataFrame, write: Callable[[Iterator[dict]], None]) -> None:
        """Apply a writer to the rows of each task, in their order."""

        def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0

            def rows() -> Iterator[dict]:
                nonlocal n
                for batch in batches_:
                    for k in range(batch.num_rows):
                        n += 1
                        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}

            write(rows())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        df.mapInArrow(run, "n long").agg(F.sum("n")).collect()

    def files(rows: Iterator[dict]) -> None:
        out, target, expected, part = None, None, 0, ""
        for r in rows:
            if r["body"] is None or r["piece"] != expected:
                raise ValueError(f"the archive has no whole body of {r['rel']}")
            if expected == 0:
                target = os.path.join(dest, r["rel"])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                out = open(part, "wb")  # noqa: SIM115
            out.write(r["body"])
            expected += 1
            if expected == r["pieces"]:
                out.close()
                restore(part, r)
                os.replace(part, target)
                expected = 0
        if expected:
            raise ValueError(f"the archive has no whole body of {target}")

    def folders(rows: Iterator[dict]) -> None:
        for r in rows:
            os.makedirs(os.path.join(dest, r["rel"]), exist_ok=True)

    def links(rows: Iterator[dict]) -> None:
        for r in rows:
            target = os.path.join(dest, r["rel"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            if os.path.lexists(target):
                os.remove(target)
            if r["kind"] == 2:
                os.symlink(r["link_target"], target)
            else:
                os.link(os.path.join(dest, r["link_target"]), target)

    def finish(rows: Iterator[dict]) -> None:
        for r in rows:
            restore(os.path.join(dest, r["rel"]), r)

    each(every.where("kind = 1").select("rel"), folders)
    # of one path in several batches the last stays
    latest = every.where("kind IN (0, 4, 5, 6)").groupBy("rel").agg(F.max("batch").alias("batch"))
    wanted = every.join(latest, ["rel", "batch"]).select("rel", "batch", "mode", "mtime", "xattrs", "pieces")
    whole = wanted.join(bodies(spark, path).drop("pieces"), ["rel", "batch"], "left")
    whole = whole.select("rel", "mode", "mtime", "xattrs", "pieces", F.coalesce("piece", F.lit(0)).alias("piece"), "body")
    each(whole.repartition("rel").sortWithinPartitions("rel", "piece"), files)
    each(every.where("kind IN (2, 3)").select("rel", "kind", "link_target"), links)
    each(every.where("kind = 1").select("rel", "mode", "mtime", "xattrs"), finish)
    return every.count()
