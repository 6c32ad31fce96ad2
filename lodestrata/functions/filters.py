"""Reversible filters of byte strings: long-range repeats (two kinds), context prediction, delta, words. Each blob is a
block of its own, so blobs can be filtered anywhere and in any order."""

from __future__ import annotations

import re
import struct

import numpy as np

from . import fixed

_U = np.uint64


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number and where it ends; of more than ten bytes it is an error."""
    n = 0
    for k in range(10):
        n |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            return n, at + k + 1
    raise ValueError("a number is too long")


def fnv_windows(b: np.ndarray, width: int) -> np.ndarray:
    """FNV-1a of 32 bits of every window."""
    h = np.full(max(0, len(b) - width + 1), fixed.FNV_OFFSET, np.uint32)
    for k in range(width):
        h = (h ^ b[k : k + len(h)]) * np.uint32(fixed.FNV_PRIME)
    return h


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Positions, ascending, whose key occurs more than once."""
    if len(keys) < 2:
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return np.sort(order[twice])


def _agree(b: np.ndarray, i: int, j: int, most: int) -> int:
    """How many bytes are the same from i and from j on, at most `most`."""
    n = 0
    while n < most:
        step = min(4096, most - n)
        unlike = np.flatnonzero(b[i + n : i + n + step] != b[j + n : j + n + step])
        if len(unlike):
            return n + int(unlike[0])
        n += step
    return n


def _written(data: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The block's length, then literals and (match length, distance back) in turn, a match of 0 last."""
    out, at = [struct.pack("<Q", len(data))], 0
    for start, length, back in found:
        out += [put_varint(start - at), data[at:start], put_varint(length), put_varint(back)]
        at = start + length
    return b"".join([*out, put_varint(len(data) - at), data[at:], put_varint(0)])


def rep_encode(data: bytes, window: int = fixed.REP_WINDOW) -> bytes:
    """Repeats of `window` bytes or more: every literal position is indexed by its window's hash, the last one wins;
    a match ends before its own source would overlap it."""
    b = np.frombuffer(data, np.uint8)
    keys = fnv_windows(b, window) & np.uint32(fixed.REP_SLOTS - 1)
    found, at, last = [], 0, {}
    for i in _repeated(keys).tolist():
        if i < at:
            continue
        j = last.get(int(keys[i]), -1)
        last[int(keys[i])] = i
        if j >= 0 and j + window <= i:
            n = _agree(b, i, j, min(len(b) - i, i - j))
            if n >= window:
                found.append((i, n, i - j))
                at = i + n
    return _written(data, found)


def srep_encode(data: bytes, window: int = fixed.SREP_WINDOW) -> bytes:
    """Repeats of `window` bytes or more found by one anchor a block: the window in it with the largest hash. A match
    grows both ways and may run into itself."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < window:
        return _written(data, [])
    prime, inverse = fixed.SREP_PRIME, pow(fixed.SREP_PRIME, -1, 1 << 64)
    up = np.cumprod(np.concatenate([[_U(1)], np.full(len(b), _U(prime))]), dtype=_U)
    down = np.cumprod(np.concatenate([[_U(1)], np.full(len(b), _U(inverse))]), dtype=_U)
    sums = np.concatenate([[_U(0)], np.cumsum((b.astype(_U) + _U(1)) * down[: len(b)], dtype=_U)])
    h = (sums[window:] - sums[:-window]) * up[: len(b) - window + 1]
    found, at, last = [], 0, {}
    for first in range(0, len(h), window):
        i = first + int(np.argmax(h[first : first + window]))
        key = int(h[i]) & fixed.REP_SLOTS - 1
        j = last.get(key, -1)
        last[key] = i
        if j < 0 or i < at:
            continue
        ahead = _agree(b, i, j, len(b) - i)
        if ahead < window:
            continue
        back, most = 0, min(i - at, j)
        while back < most and b[i - back - 1] == b[j - back - 1]:
            back += 1
        found.append((i - back, ahead + back, i - j))
        at = i + ahead
    return _written(data, found)


def rep_decode(coded: bytes) -> bytes:
    """What rep_encode or srep_encode has written."""
    (size,) = struct.unpack_from("<Q", coded)
    out, at = bytearray(), 8
    while True:
        n, at = get_varint(coded, at)
        out += coded[at : at + n]
        length, at = get_varint(coded, at + n)
        if not length:
            break
        back, at = get_varint(coded, at)
        if not 0 < back <= len(out):
            raise ValueError("a match reaches before the block")
        while length:  # it may overlap what it writes
            step = out[len(out) - back : len(out) - back + length]
            out += step
            length -= len(step)
    if len(out) != size:
        raise ValueError("a block has another length than it says")
    return bytes(out)


def _contexts(b: np.ndarray) -> np.ndarray:
    """Slot of the context before each position from LZP_CONTEXT on."""
    return fnv_windows(b, fixed.LZP_CONTEXT) & np.uint32(fixed.LZP_SLOTS - 1)


def _again(b: np.ndarray, width: int) -> np.ndarray:
    """Positions, ascending, of windows (a power of two wide) that occur more than once, by a 64-bit hash."""
    h, n = b.astype(_U), 1
    while n < width:
        h = h[: len(h) - n] * _U(0x9E3779B97F4A7C15) + (h[n:] ^ (h[n:] >> _U(29)))
        n *= 2
    return _repeated(h)


def lzp_encode(data: bytes) -> bytes:
    """Predicts what follows a context by what followed it last; a prediction that holds for LZP_MATCH bytes or more is
    written by its length alone. The block's length, then literals and match lengths in turn, a match of 0 last.

    Only a window of LZP_MATCH bytes that occurs twice can begin a match, so only these positions are looked at; what a
    slot held then is found along the chain of earlier positions with that slot, without those inside matches."""
    b = np.frombuffer(data, np.uint8)
    found, at = [], 0
    width, least = fixed.LZP_CONTEXT, fixed.LZP_MATCH
    maybe = _again(b, least) if len(b) >= width + least else np.zeros(0, np.int64)
    maybe = maybe[maybe >= width]
    if len(maybe):
        slots = _contexts(b)
        order = np.argsort(slots, kind="stable")
        before = np.full(len(slots), -1, np.int64)
        same = slots[order][1:] == slots[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        inside = np.zeros(len(b), bool)
        k = 0
        while k < len(maybe):
            i = int(maybe[k])
            if i < at:
                k = int(np.searchsorted(maybe, at))
                continue
            k += 1
            j = int(before[i - width])
            while j >= 0 and inside[j + width]:
                j = int(before[j])
            j += width
            if j >= width and j + least <= i:
                n = _agree(b, i, j, min(len(b) - i, i - j))
                if n >= least:
                    found.append((i, n))
                    at = i + n
                    inside[i + 1 : at] = True
    out, at = [struct.pack("<Q", len(data))], 0
    for start, n in found:
        out += [put_varint(start - at), data[at:start], put_varint(n)]
        at = start + n
    return b"".join([*out, put_varint(len(data) - at), data[at:], put_varint(0)])


#: The position behind the last context of each slot; a decoder clears what it has set.
_LAST = np.full(fixed.LZP_SLOTS, -1, np.int64)


def lzp_decode(coded: bytes) -> bytes:
    (size,) = struct.unpack_from("<Q", coded)
    out, at, used = bytearray(), 8, []
    width = fixed.LZP_CONTEXT
    try:
        while True:
            n, at = get_varint(coded, at)
            begin = len(out)
            out += coded[at : at + n]
            length, at = get_varint(coded, at + n)
            if not length:
                break
            # contexts that end where a literal or the coming match stands
            low = max(begin, width)
            slots = _contexts(np.frombuffer(bytes(out[low - width :]), np.uint8)) if len(out) >= low else np.zeros(0, np.uint32)
            source = -1
            if len(slots):
                _LAST[slots[:-1]] = np.arange(low, low + len(slots) - 1)  # of a slot set twice the last stays
                used.append(slots)
                source = int(_LAST[slots[-1]])
                _LAST[slots[-1]] = low + len(slots) - 1
            if source < 0 or source + length > len(out):
                raise ValueError("a prediction has no source")
            out += out[source : source + length]
    finally:
        for slots in used:
            _LAST[slots] = -1
    if len(out) != size:
        raise ValueError("a block has another length than it says")
    return bytes(out)


def delta_encode(data: bytes, stride: int) -> bytes:
    """Each byte less the one a stride before it, from zeros."""
    b = np.frombuffer(data, np.uint8)
    before = np.concatenate([np.zeros(min(stride, len(b)), np.uint8), b[: max(0, len(b) - stride)]])
    return (b - before).tobytes()


def delta_decode(data: bytes, stride: int) -> bytes:
    b = np.frombuffer(data, np.uint8).copy()
    for k in range(stride):
        b[k::stride] = np.cumsum(b[k::stride], dtype=np.uint8)
    return b.tobytes()


_TOKENS = {b" " + w.encode(): bytes([0x80 + k]) for k, w in enumerate(fixed.DICTIONARY_WORDS)}
_SPOKEN = {v: k for k, v in _TOKENS.items()}
_ESCAPE = bytes([fixed.DICTIONARY_ESCAPE])
_ENCODE = re.compile(b"(?:" + b"|".join(sorted(map(re.escape, _TOKENS), key=len, reverse=True)) + b")(?![A-Za-z])|[\x01\x80-\xff]", re.S)
_DECODE = re.compile(b"\x01(.)|[\x80-\xff]", re.S)


def words_encode(data: bytes) -> bytes:
    """Frequent words with the blank before them become one byte each, unless a letter follows."""
    return _ENCODE.sub(lambda m: _TOKENS.get(m[0]) or _ESCAPE + m[0], data)


def words_decode(data: bytes) -> bytes:
    return _DECODE.sub(lambda m: m[1] if m[1] is not None else _SPOKEN[m[0]], data)


FILTERS = {
    "rep": (rep_encode, rep_decode),
    "srep": (srep_encode, rep_decode),
    "lzp": (lzp_encode, lzp_decode),
    "words": (words_encode, words_decode),
    **{f"delta{n}": (lambda b, n=n: delta_encode(b, n), lambda b, n=n: delta_decode(b, n)) for n in fixed.DELTA_STRIDES},
}
