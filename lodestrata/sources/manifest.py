"""Files as entries: folders, single files, globs and lists. The driver looks into the first folders of a source only; the
folders below are walked, and contents read, by the executors, so the paths must be theirs too. The set of files is pinned
once, in a written table. Files of any size are read in pieces, so no cell and no task holds a whole volume."""

from __future__ import annotations

import glob
import hashlib
import os
import stat
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalars
from ..plans.storage import file_system, settled

SCHEMA = "full string, rel string, kind int, is_regular boolean, size long, mtime long, mode long, link_target string, xattrs array<struct<name:binary,value:binary>>"
#: Bytes of a file that one row holds; folders that the driver opens itself; rows of a batch.
PIECE, OPENED, ROWS = 64 << 20, 64, 1000


def extended(path: str) -> list[tuple[bytes, bytes]]:
    """Extended attributes, by name; none where the system has none."""
    try:
        return sorted((os.fsencode(n), os.getxattr(path, n, follow_symlinks=False)) for n in os.listxattr(path, follow_symlinks=False))
    except (AttributeError, OSError):
        return []


def _entry(full: str, rel: str) -> tuple:
    try:
        st = os.lstat(full)
    except OSError:
        return full, rel.replace("\\", "/"), 0, False, None, None, None, "", []
    link, folder = stat.S_ISLNK(st.st_mode), stat.S_ISDIR(st.st_mode)
    return full, rel.replace("\\", "/"), 2 if link else 1 if folder else 0, stat.S_ISREG(st.st_mode), 0 if link or folder else st.st_size, int(st.st_mtime // 1), stat.S_IMODE(st.st_mode), os.readlink(full) if link else "", extended(full)


def _walk(root: str, under: str) -> Iterator[tuple]:
    """The root and all below it, in order, without following links; names that begin with a dot, and empty files too."""
    yield _entry(root, os.path.relpath(root, under))
    with os.scandir(root) as found:
        for e in sorted(found, key=lambda e: e.name):
            if e.is_dir(follow_symlinks=False):
                yield from _walk(e.path, under)
            else:
                yield _entry(e.path, os.path.relpath(e.path, under))


def expanded(source: str) -> list[str]:
    """A source as paths: as it is, unless it has one of * ? [; a pattern that matches nothing is an error."""
    if not any(c in source for c in "*?["):
        return [source]
    found = sorted(glob.glob(source))
    if not found:
        raise FileNotFoundError(f"nothing matches {source}")
    return found


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The paths of a list: one a line, trimmed, without blank lines and those that begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("length(path) > 0 AND NOT startswith(path, '#')")


def _opened(root: str, under: str) -> list[tuple[tuple, str | None]]:
    """The entries of the first folders, from the root on, each with the folder that is still to be walked, if it is one."""
    found: list[tuple[tuple, str | None]] = [(_entry(root, os.path.relpath(root, under)), None)]
    todo = [root]
    for _ in range(OPENED):
        if not todo:
            break
        folder = todo.pop(0)
        with os.scandir(folder) as inside:
            for e in sorted(inside, key=lambda e: e.name):
                if e.is_dir(follow_symlinks=False):
                    todo.append(e.path)
                    found.append((_entry(e.path, os.path.relpath(e.path, under)), None))
                else:
                    found.append((_entry(e.path, os.path.relpath(e.path, under)), None))
    return found + [((folder, under), folder) for folder in todo]


def manifest(spark: SparkSession, sources: Iterable[str], keep_root: bool = True) -> DataFrame:
    """Entries of all sources, one after another, without looking for the same file twice. A folder's entries keep its
    own name in `rel`, unless keep_root is false; a file's `rel` is its name."""
    rows: list[tuple] = []
    deep: list[tuple[str, str]] = []
    for source in (p for s in sources for p in expanded(s)):
        full = os.path.realpath(source)
        if os.path.isdir(full):
            for row, folder in _opened(full, os.path.dirname(full) if keep_root else full):
                if folder is not None:
                    deep.append(row)
                elif keep_root or row[1] != ".":
                    rows.append(row)
        elif os.path.lexists(source):
            rows.append(_entry(full, os.path.basename(source)))
        else:
            raise FileNotFoundError(source)
    found = spark.createDataFrame(rows, SCHEMA)
    if deep:
        shape = to_arrow_schema(found.schema)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            for batch in batches:
                for folder, under in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for row in _walk(folder, under):
                        if row[0] == folder:
                            continue  # it is among the first
                        held.append(dict(zip(shape.names, row, strict=True)) | {"xattrs": [{"name": n, "value": v} for n, v in row[-1]]})
                        if len(held) >= ROWS:
                            yield pa.RecordBatch.from_pylist(held, shape)
                            held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, shape)

        folders = spark.createDataFrame(deep, "folder string, under string").repartition(min(len(deep), 4096))
        found = found.unionByName(settled(folders.mapInArrow(walk, SCHEMA), "manifest"))
    return found.withColumn("ext", scalars.extension(F.col("rel")))


def remote(spark: SparkSession, root: str) -> DataFrame:
    """Regular files below a folder of any file system that Hadoop knows, as entries with bodies, read by Spark itself; a
    file that is too large for a cell is an error there. Folders and links have no rows, nor have names that begin with . or _."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    fs, at = file_system(spark, root)
    base = str(fs.makeQualified(at)).rstrip("/") + "/"
    rel = F.substring("path", len(base) + 1, 1 << 20)
    rows = found.select(F.col("path").alias("full"), rel.alias("rel"), F.lit(0).alias("kind"), F.lit(True).alias("is_regular"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), F.lit(None).cast("long").alias("mode"), F.lit("").alias("link_target"), F.col("content").alias("body"))
    return rows.withColumn("ext", scalars.extension(F.col("rel")))


def _pieces(path: str, size: int, piece: int) -> Iterator[tuple[int, bytes]]:
    with open(path, "rb") as f:
        for k in range(max(1, -(-size // piece))):
            yield k, f.read(min(piece, size - k * piece))


def _digested(path: str, piece: int) -> tuple[int, bytes]:
    """Bytes and SHA-256 of a file, read in pieces."""
    n, state = 0, hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(piece):
            n += len(part)
            state.update(part)
    return n, state.digest()


def with_bodies(entries: DataFrame, piece: int = PIECE) -> DataFrame:
    """The entries with `body`, `piece`, `pieces` and `sha256` (of the whole file). A regular file of more than `piece` bytes
    has a row for each piece of it, from 0; all others have one. Folders and links have no body; nor has a file that can't
    be read, or is no longer as long as its entry says: its body and digest are null, and pack() refuses it."""
    names = entries.columns
    added = [T.StructField("body", T.BinaryType()), T.StructField("piece", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("sha256", T.BinaryType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full, regular, sizes = (batch.column(names.index(n)).to_pylist() for n in ("full", "is_regular", "size"))
            for k, (path, is_file, size) in enumerate(zip(full, regular, sizes, strict=True)):
                row = lambda *values: pa.RecordBatch.from_arrays([*(batch.column(i).slice(k, 1) for i in range(len(names))), *(pa.array([v], t) for v, t in zip(values, (pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True))], names=[*names, "body", "piece", "pieces", "sha256"])  # noqa: B023, E731
                digest = None
                if is_file and size is not None:
                    try:
                        n, digest = _digested(path, piece) if size > piece else (size, None)
                        if n == size:
                            for place, part in _pieces(path, size, piece):
                                if len(part) != min(piece, size - place * piece):
                                    raise OSError(f"{path} has become shorter")
                                yield row(part, place, max(1, -(-size // piece)), digest or hashlib.sha256(part).digest())
                            continue
                    except OSError:
                        pass
                yield row(None, 0, 1, None)

    return entries.mapInArrow(read, T.StructType([*entries.schema.fields, *added]))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """rel (below the root), size and crc32 of everything in a folder; (0, 0) for folders and links. Files of any size are
    read in pieces. A file that can't be read has a null crc32, which is equal to nothing."""
    every = manifest(spark, [root], keep_root=False).select("rel", "full", "is_regular", "size")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, regular, size in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                crc = n = 0
                if regular:
                    try:
                        with open(path, "rb") as f:
                            while part := f.read(PIECE):
                                crc, n = zlib.crc32(part, crc), n + len(part)
                    except OSError:
                        n, crc = size, None
                found.append((n, crc))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["rel", "size", "crc32"])

    return every.mapInArrow(read, "rel string, size long, crc32 long")


def parts(path: str) -> list[str]:
    """The files of an archive that was split: path itself, else path.001, path.002 and so on."""
    if os.path.exists(path):
        return [path]
    found = []
    while os.path.exists(name := f"{path}.{len(found) + 1:03d}"):
        found.append(name)
    if not found:
        raise FileNotFoundError(path)
    return found
