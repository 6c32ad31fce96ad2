"""Codecs of byte strings, and columns that apply codecs and filters over Arrow batches."""

from __future__ import annotations

import lzma
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import filters, settings

#: Window logarithm that readers accept, and that writers use for long distances.
READ_WINDOW, LONG_WINDOW = 31, 28
#: Bytes that every level's own window reaches.
NEAR = 512 << 10
_BRANCHES = {"x86": lzma.FILTER_X86, "arm": lzma.FILTER_ARM, "armt": lzma.FILTER_ARMTHUMB, "ia64": lzma.FILTER_IA64, "sparc": lzma.FILTER_SPARC, "ppc": lzma.FILTER_POWERPC}


@lru_cache(maxsize=8)
def _zstd(level: int, long: bool, dictionary: bytes | None) -> zstandard.ZstdCompressor:
    grade = settings.zstd_level(level)
    extra: dict = {"window_log": LONG_WINDOW, "enable_ldm": True} if long else {}
    if level == 4:
        extra |= {"strategy": zstandard.STRATEGY_BTULTRA2, "chain_log": 28, "hash_log": 27, "search_log": 10, "target_length": 999}
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(dict_data=given, compression_params=zstandard.ZstdCompressionParameters.from_level(grade, write_checksum=True, **extra))


def zstd_encode(data: bytes, level: int = 3, long: bool = False, dictionary: bytes | None = None) -> bytes:
    """long: a window beyond the level's own, for bodies that are larger than NEAR."""
    return _zstd(level, long and len(data) > NEAR, dictionary).compress(data)


def zstd_decode(data: bytes, dictionary: bytes | None = None) -> bytes:
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=given, max_window_size=1 << READ_WINDOW).decompress(data)


def lzma_encode(data: bytes, level: int = 5, branch: str | None = None, knobs: dict[str, int] | None = None) -> bytes:
    """xz with the strongest preset, literal bits for text, and a dictionary no larger than the data needs. More than a
    block is written as streams of a block each, which decoders read as one."""
    knob = {k: (knobs or {}).get(k, v) for k, v in settings.KNOBS.items()}
    largest = knob["lzma.dict"] or settings.lzma_dictionary(level)
    size = min(max(4096, largest), max(4096, 1 << max(0, len(data) - 1).bit_length()))
    chain = [{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME, "lc": knob["lzma.lc"], "lp": knob["lzma.lp"], "pb": knob["lzma.pb"], "nice_len": knob["lzma.nice"], "dict_size": size}]
    if branch:
        chain.insert(0, {"id": _BRANCHES[settings.branch_filter(branch)]})
    block = knob["lzma.block"] * settings.MIB or settings.lzma_block(level)
    return b"".join(lzma.compress(data[k : k + block], format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC64, filters=chain) for k in range(0, max(1, len(data)), block))


#: Recompressors by kind of entry: (encode, decode). None is available here; an encoder that fails or is absent leaves
#: the entry a plain file.
RECOMPRESSORS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {}


def recompressed(kind: str, data: bytes) -> bytes | None:
    """The body of a recompressed image, or None: then it stays a plain file. Images are told by their first bytes."""
    magic = {"jpeg": b"\xff\xd8", "png": b"\x89PNG"}[kind]
    if not data.startswith(magic) or kind not in RECOMPRESSORS:
        return None
    return attempted(RECOMPRESSORS[kind][0])(data)


def attempted(encode: Callable[[bytes], bytes]) -> Callable[[bytes], bytes | None]:
    """An encoder that gives None where it fails."""

    def tried(data: bytes) -> bytes | None:
        try:
            return encode(data)
        except Exception:  # as for any failure of a codec
            return None

    return tried


def trained_dictionary(samples: list[bytes], size: int) -> bytes | None:
    """A zstd dictionary from a bounded sample; none from less than 1 MiB or seven samples."""
    if len(samples) < 7 or sum(map(len, samples)) < 1 << 20:
        return None
    return zstandard.train_dictionary(size, samples).as_bytes()


def applied(body: Column, f: Callable[[bytes], bytes]) -> Column:
    """A function of bytes over a binary column; null stays null."""

    @F.pandas_udf(BinaryType())
    def over(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else f(bytes(b)))

    return over(body)


def encoded(body: Column, codec: str, level: int = 3, branch: str | None = None, dictionary: bytes | None = None, long: bool = False, knobs: dict[str, int] | None = None) -> Column:
    """store, zstd or lzma."""
    if codec == "store":
        return body
    if codec == "zstd":
        return applied(body, lambda b: zstd_encode(b, level, long, dictionary))
    if codec == "lzma":
        return applied(body, lambda b: lzma_encode(b, level, branch, knobs))
    raise ValueError(f"codec not available: {codec}")


def decoded(body: Column, codec: str, dictionary: bytes | None = None) -> Column:
    if codec == "store":
        return body
    if codec == "zstd":
        return applied(body, lambda b: zstd_decode(b, dictionary))
    if codec == "lzma":
        return applied(body, lzma.decompress)
    raise ValueError(f"codec not available: {codec}")


def filtered(body: Column, name: str) -> Column:
    return applied(body, filters.FILTERS[name][0])


def unfiltered(body: Column, name: str) -> Column:
    return applied(body, filters.FILTERS[name][1])
