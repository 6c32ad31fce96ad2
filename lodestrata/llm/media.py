"""Media columns: content-addressed payloads in tar shards, with metadata read from headers alone.

A payload of bytes is stored as an 8-bit greyscale PNG of one row, which keeps every sample, under the SHA-256
of the payload as its name. Each task appends its distinct payloads to one tar shard on shared storage; rows carry the
digest, the shard, and the offset and length of the stored form. Of the copies that several tasks have stored, one is
the address of the digest. Metadata columns come from range reads of the tar and PNG headers; features need the bytes.

Shards have names of their own for every attempt of a task, and a row names the shard that its attempt wrote, so lost
executors and repeated attempts leave at most shards that no row names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Payloads are padded to a multiple of it. Level of the lossless compression. Bytes of a shard.
WIDTH, LEVEL, SHARD = 64, 5, 256 << 20
#: Documents that one row of the index names; a payload of more has several rows.
NAMED = 4096
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a stored form that hold its header: signature and IHDR.
HEADER = 33

STORED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType()))])


def payload(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encoded(samples: bytes) -> bytes:
    """The samples as a PNG."""
    # filter 0 stands before a row; with one row there is one, and matches run through
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", len(samples), 1, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"\0" + samples, LEVEL)) + _chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth of a PNG from its first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decoded(stored: bytes) -> bytes:
    """The samples of a PNG that encoded() made."""
    width, height, _ = header(stored[:HEADER])
    at, body = 8, []
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        if zlib.crc32(stored[at + 4 : at + 8 + n]) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            body.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header of a regular file."""
    head = bytearray(512)
    for at, field in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(field)] = field
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


class _Shard:
    """A tar file that is written once, from front to end."""

    def __init__(self, base: str):
        import uuid

        self.path = f"{base}/shard-{uuid.uuid4().hex}.tar"
        fs, at = common.filesystem(self.path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out, self.size = fs.open_output_stream(at), 0

    def add(self, name: str, body: bytes) -> int:
        """The offset of the body."""
        start = self.size + 512
        self.out.write(_tar_header(name, len(body)) + body + bytes(-len(body) % 512))
        self.size = start + len(body) + -len(body) % 512
        return start

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, base: str) -> DataFrame:
    """Write every payload of docs (doc_id, text) to shards in a folder of shared storage. A row for each payload, task and NAMED
    documents: digest, shard, offset, length, n_bytes, and the doc_ids that have it there. Null texts are stored as empty ones."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        held: dict[bytes, list] = {}

        def rows(every: list[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(every), 5000):
                part = every[k : k + 5000]
                yield pa.RecordBatch.from_pydict({"digest": [d for d, _ in part], "shard": [shard.path.rsplit("/", 1)[1]] * len(part), "offset": [v[0] for _, v in part], "length": [v[1] for _, v in part], "n_bytes": [v[2] for _, v in part], "doc_ids": pa.array([v[3] for _, v in part], pa.list_(pa.int64()))})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if shard is None:
                    shard = _Shard(base)
                samples = payload(text or b"")
                digest = hashlib.sha256(samples).digest() + len(text or b"").to_bytes(8, "big")  # zeros at a text's end stay its own
                if digest in held:
                    if len(held[digest][3]) >= NAMED:  # a text may have any number of copies
                        yield from rows([(digest, held[digest])])
                        held[digest] = [*held[digest][:3], []]
                    held[digest][3].append(doc)
                    continue
                body = encoded(samples)
                held[digest] = [shard.add(f"{digest.hex()}.png", body), len(body), len(text or b""), [doc]]
                if shard.size >= SHARD or len(held) >= SHARD >> 10:
                    shard.close()
                    yield from rows(list(held.items()))
                    shard, held = None, {}
        if shard is not None:
            shard.close()
            yield from rows(list(held.items()))

    return common.settled(common.wanted(docs, doc_id="long", text="string").mapInArrow(write, STORED), "media-index")


def metadata(index: DataFrame, base: str) -> DataFrame:
    """The rows of (digest, shard, offset, length) with width, height, depth and stored_name, from headers alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for source, offset in _opened(batch, base):
                head = source.read_at(512 + HEADER, offset - 512)
                found.append((*header(head[512:]), head[:100].rstrip(b"\0").decode()))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True))], names=[*batch.schema.names, "width", "height", "depth", "stored_name"])

    return index.select("digest", "shard", "offset", "length").mapInArrow(read, "digest binary, shard string, offset long, length long, width int, height int, depth int, stored_name string")


def _opened(batch: pa.RecordBatch, base: str) -> Iterator[tuple]:
    """The open shard and the offset of each row."""
    path = source = None
    for shard, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        if shard != path:
            if source is not None:
                source.close()
            fs, at = common.filesystem(f"{base}/{shard}")
            path, source = shard, fs.open_input_file(at)
        yield source, offset
    if source is not None:
        source.close()


def features(index: DataFrame, base: str) -> DataFrame:
    """For each row of metadata(): digest, payload_bytes, payload_sha256, tail_crc32 (last WIDTH samples), media_bytes,
    media_sha256, feature (shape, mean, deviation, entropy and distinct values of the samples), all from stored bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (source, offset), digest, length, width, height, depth in zip(_opened(batch, base), *(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)), strict=True):
                stored = source.read_at(length, offset)
                samples = decoded(stored)
                own = hashlib.sha256(samples).hexdigest()
                if own != digest[:32].hex():
                    raise ValueError(f"a payload differs from its address {digest.hex()}")
                n = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
                p = n[n > 0] / n.sum()
                values = np.arange(256)
                mean = (n * values).sum() / n.sum()
                feature = f"png:{width}x{height}x{depth};mean={mean:.4f};sd={np.sqrt((n * (values - mean) ** 2).sum() / n.sum()):.4f};entropy={max(0.0, -(p * np.log2(p)).sum()):.4f};distinct={len(p)}"
                out.append((digest, len(samples), bytes.fromhex(own), zlib.crc32(samples[-WIDTH:]), len(stored), hashlib.sha256(stored).digest(), feature))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return index.mapInArrow(read, "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def media_columns(docs: DataFrame, base: str | None = None) -> DataFrame:
    """Shards go to the folder `base`, where they stay; without one, to the application's own, which goes with it. Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and
    the address: shard, offset, length. Null texts count as empty, whose payload is WIDTH zeros. Equal texts have equal
    values and one address. Repeated rows give repeated results; a null doc_id stays null; other columns are ignored."""
    base = base or common.fresh_path(docs.sparkSession, "media")
    index = store(docs, base)
    # of the copies of several tasks, one is read; its rows are as many as distinct payloads
    address = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.*")
    ordered = address.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    heads = metadata(ordered, base)
    read = common.settled(features(heads, base).join(address, "digest").withColumnRenamed("digest", "of"), "media-features")
    rows = index.select("digest", "n_bytes", "doc_ids").join(read, F.col("digest") == F.col("of"))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select(F.explode("doc_ids").alias("doc_id"), "n_bytes", "payload_bytes", hexed("payload_sha256"), "tail_crc32", "media_bytes", hexed("media_sha256"), "feature", F.concat(F.lit(base + "/"), "shard").alias("shard"), "offset", "length")
