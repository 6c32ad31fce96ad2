"""Scalar functions of entries as column expressions, and the parsers of options as plain functions."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def extension(rel: Column) -> Column:
    """Lower-cased letters after the last dot of the file's name; none for dotfiles and a trailing dot."""
    return F.lower(F.regexp_extract(rel, r"[^/]\.([^./]*)$", 1))


def content_kind(ext: Column) -> Column:
    """Jpeg, Png, Media or Other, by extension."""
    return F.when(ext.isin(fixed.JPEG_EXTENSIONS), "Jpeg").when(ext.isin(fixed.PNG_EXTENSIONS), "Png").when(ext.isin(fixed.MEDIA_EXTENSIONS), "Media").otherwise("Other")


def routed(ext: Column) -> Column:
    """Whether the router stores the extension without compression."""
    return ext.isin(fixed.ROUTED_EXTENSIONS)


def sniffed(body: Column) -> Column:
    """Jpeg, Png or Other, by the first bytes; null is Other."""
    return F.when(F.startswith(body, F.lit(b"\xff\xd8")), "Jpeg").when(F.startswith(body, F.lit(b"\x89PNG")), "Png").otherwise("Other")


def _scaled(n: Column) -> tuple[Column, Column]:
    value, unit = n.cast("double"), F.lit(_UNITS[0])
    steps = [(1024.0**k, _UNITS[k]) for k in range(1, len(_UNITS))]
    scaled, name = value, unit
    for size, text in steps:  # the largest unit that fits wins, so the later ones override
        scaled = F.when(n >= int(size), value / size).otherwise(scaled)
        name = F.when(n >= int(size), text).otherwise(name)
    return F.bround(scaled, 2), name  # ties to even; Java's format alone would round them up


def human_size(n: Column) -> Column:
    """1536 -> '1.50 KB', in steps of 1024 up to PB."""
    scaled, name = _scaled(n)
    return F.format_string("%.2f %s", scaled, name)


def human_size_padded(n: Column) -> Column:
    """As human_size, the number in seven places, a blank before B."""
    scaled, name = _scaled(n)
    return F.format_string("%7.2f %s", scaled, F.when(name == "B", " B").otherwise(name))


def dotted(n: Column) -> Column:
    """131858 -> '131.858'."""
    return F.translate(F.format_number(n, 0), ",", ".")


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS; hours are not bounded."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def shown_time(mtime: Column) -> Column:
    """Seconds since 1970 as 'YYYY-MM-DD HH:MM:SS' in UTC; earlier ones as 1970. Needs a session in UTC."""
    return F.date_format(F.timestamp_seconds(F.greatest(mtime, F.lit(0))), "yyyy-MM-dd HH:mm:ss")


def listed_time(mtime: Column) -> Column:
    """shown_time, but blanks for nothing after 1970."""
    return F.when(mtime <= 0, " " * 19).otherwise(shown_time(mtime))


def kind_tag(kind: Column) -> Column:
    """Five characters for the kind of an entry, blanks for a plain file."""
    out = F.lit(" " * 5)
    for k, tag in fixed.ENTRY_TAGS.items():
        out = F.when(kind == k, tag).otherwise(out)
    return out


def file_like(kind: Column) -> Column:
    return kind.isin(fixed.FILE_LIKE)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def throughput(n: Column, seconds: Column) -> Column:
    """MiB a second, 0 in no time."""
    return share(n / (1024.0 * 1024.0), seconds)


def ratio_class(ratio: Column) -> Column:
    return F.when(ratio >= 0.95, "poor").when(ratio < 0.80, "good").otherwise("neutral")


def slashes(rel: Column) -> Column:
    """Backslashes as slashes."""
    return F.translate(rel, "\\", "/")


def dictionary_size(total: Column) -> Column:
    """The size of a compression dictionary for so many bytes."""
    mib = 1 << 20
    return F.when(total < 64 * mib, 64 * 1024).when(total < 512 * mib, 112_640).when(total < 2048 * mib, 192 * 1024).otherwise(256 * 1024).cast("long")


def looks_like_text(body: Column) -> Column:
    """Whether nine tenths of the bytes are tab, LF, CR or 0x20 to 0x7E; not for no bytes. Bytes are read as Latin-1, so
    each is one character."""
    plain = F.length(F.regexp_replace(F.decode(body, "ISO-8859-1"), r"[^\t\n\r\x20-\x7e]", ""))
    return (F.octet_length(body) > 0) & (plain * 10 >= F.octet_length(body) * 9)


def parse_size(text: str) -> int:
    """'1.5k' -> 1536. Suffixes B, K, KB, KiB ... T, in any case, are all powers of 1024; whole numbers saturate."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*(?:([kmgt])(?:i?b)?|b)?\s*", text, re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    factor = 1024 ** (" kmgt".index(m[2].lower()) if m[2] else 0)
    return min(int(m[1]) * factor, 2**64 - 1) if m[1].isdigit() else int(float(m[1]) * factor)


def parse_date(text: str) -> int:
    """Seconds since 1970, in UTC: digits as they are; Y-M-D as its midnight. Days beyond a month's end roll over."""
    text = text.strip()
    if text.isdigit():
        return int(text)
    m = re.fullmatch(r"(-?\d+)-(\d{1,2})-(\d{1,2})", text)
    if not m or not 1 <= int(m[2]) <= 12 or not 1 <= int(m[3]) <= 31:
        raise ValueError(f"not a date: {text!r}")
    return ((date(int(m[1]), int(m[2]), 1) - date(1970, 1, 1)).days + int(m[3]) - 1) * 86_400


def hash_name(text: str | None) -> str:
    found = fixed.HASH_NAMES.get((text or "").strip().lower())
    if found is None:
        raise ValueError(f"unknown hash: {text!r}")
    return found
