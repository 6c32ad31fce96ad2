"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

The segments of a batch of texts that have not been seen are concatenated and indexed by a suffix array, sorted as deep
as the longest piece. Every piece is binary-searched in it for its range of occurrences; each occurrence is an edge of
the segments' lattices. Edges are sorted by the position where they end and relaxed in that order, for all segments at
once: an edge reaches its end if the piece can follow the last piece of the text up to its start. For a BPE model just
one edge at each position can: the last piece of that prefix. Whether a piece can follow another is decided by running
the two pieces' own merges side by side, best score first, and asking whether a merge across them would come first. The
result is that of the greedy merges, whole texts in any order of length.

Segments are cut only where no piece could span the cut, so their pieces don't depend on their neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Segments kept with their pieces by a worker, and pairs of pieces kept as a power of two.
SEEN, PAIRS = 300_000, 21
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_NONE = -np.inf


@dataclass
class Model:
    """Symbols 0..n-1 are the vocabulary's ids; n.. are characters that are part of pieces but none themselves.
    merges: keys left * width + right, sorted, with the merged symbol's score."""

    texts: list[str]
    n_ids: int
    usable: np.ndarray
    byte_ids: np.ndarray
    chars: dict[str, int]
    cross_key: np.ndarray
    cross_score: np.ndarray
    event: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    segments: str
    cover: np.ndarray
    flat: np.ndarray

    @property
    def width(self) -> int:
        return len(self.texts) + 1


def _merges(symbols: list[int], best: dict[tuple[int, int], tuple[float, int]]) -> tuple[list[float], list[int], list[int], list[int]]:
    """Greedy merges of a string: their scores, the first and last symbol before and after each, what is left."""
    now = list(symbols)
    scores, heads, tails = [], [now[0]], [now[-1]]
    while len(now) > 1:
        top = max(((best[p][0], -k) for k, p in enumerate(zip(now, now[1:], strict=False)) if p in best), default=None)
        if top is None:
            break
        k = -top[1]
        now[k : k + 2] = [best[now[k], now[k + 1]][1]]
        scores.append(top[0]), heads.append(now[0]), tails.append(now[-1])
    return scores, heads, tails, now


def _checked(sp) -> None:
    """Refuse models of another kind, whose ids would be others: normalisers that change texts, no dummy prefix, and pieces
    that are not merged by rank (as those of unigram models, whose scores are no whole numbers)."""
    for text in ("a  b ", "\ufb01\u00c5 \uff21\u2460", " x\ty\n", "AbC"):
        if sp.normalize(text) != MARK + text.replace(" ", MARK):
            raise ValueError("the model's normaliser changes texts, or sets no mark before them")
    scores = [sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(x != int(x) or x > 0 for x in scores):
        raise ValueError("the model is not of merges by rank")


@lru_cache(maxsize=2)
def load(path: str = DEFAULT_MODEL) -> Model:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix, from its file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    _checked(sp)
    texts = [sp.id_to_piece(i) for i in range(n)]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(texts[i][1:-1], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    of = {texts[i]: i for i in range(n) if not special[i]}
    for c in sorted({c for t in of for c in t} - set(of)):
        of[c] = len(texts)
        texts.append(c)
    width = len(texts) + 1
    best = {(of[t[:k]], of[t[k:]]): (sp.get_score(i), i) for t, i in of.items() if i < n for k in range(1, len(t)) if t[:k] in of and t[k:] in of}
    longest = max(map(len, of))
    event = np.full((width, longest), _NONE)
    head, tail = np.full((width, longest), -1, np.int64), np.full((width, longest), -1, np.int64)
    usable = np.zeros(width, bool)
    for t, i in of.items():
        scores, heads, tails, left = _merges([of[c] for c in t], best)
        if len(left) == 1:
            usable[i] = True
            event[i, : len(scores)], head[i, : len(heads)], tail[i, : len(tails)] = scores, heads, tails
            head[i, len(heads) :], tail[i, len(tails) :] = heads[-1], tails[-1]
    keys = np.array([a * width + b for a, b in best], np.int64)
    by = np.argsort(keys)
    # a break stands before a mark that follows something else, and around characters of no longer piece
    if any(MARK in t.lstrip(MARK) for t in of):
        raise ValueError("a piece spans a blank")
    alone = "".join(c for c in "\n\r\t" if not any(c in t and len(t) > 1 for t in of))
    segments = (f"[{re.escape(alone)}]|" if alone else "") + f"{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+"
    spelled = [b"" if i < n and special[i] else t.replace(MARK, " ").encode() for i, t in enumerate(texts)]
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    cover = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
    return Model(texts, n, usable, byte_ids, {t: i for t, i in of.items() if len(t) == 1}, keys[by], np.array([v[0] for v in best.values()])[by], event, head, tail, segments, cover, np.frombuffer(b"".join(spelled), np.uint8))


class _Segments(dict):
    """Segments with their numbers, given in the order of first sight; those seen since the last look are in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        k = self[segment] = len(self)
        self.new.append(segment)
        return k


class Encoder:
    """Encodes batches of texts; keeps the pieces of segments and the judgement of pairs that it has seen."""

    def __init__(self, model: Model):
        self.m = model
        self.pattern = re.compile(model.segments)
        self.pair_key = np.full(1 << PAIRS, -1, np.int64)
        self.pair_ok = np.zeros(1 << PAIRS, bool)
        self.symbol = np.zeros(0x110000, np.uint16)  # 0: in no piece
        alphabet = sorted({c for i, t in enumerate(model.texts) if i >= model.n_ids or model.usable[i] for c in t})
        for k, c in enumerate(alphabet):
            self.symbol[ord(c)] = k + 1
        self.single = np.full(len(alphabet) + 1, -1, np.int64)
        for k, c in enumerate(alphabet):
            self.single[k + 1] = model.chars[c]
        self.pieces = [i for i in np.flatnonzero(model.usable).tolist() if i < model.n_ids]
        self.length = np.array([len(model.texts[i]) for i in self.pieces], np.int64)
        self.longest = int(self.length.max())
        self.spelled = np.zeros((len(self.pieces), self.longest), np.uint16)
        for k, i in enumerate(self.pieces):
            self.spelled[k, : self.length[k]] = self.symbol[[ord(c) for c in model.texts[i]]]
        self.ids = np.array(self.pieces, np.int64)
        self.forget()

    def forget(self) -> None:
        self.seen = _Segments()
        self.at = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the right symbol can follow the left one: no merge across them comes before their own."""
        key = left * self.m.width + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            ask = np.sort(key[new])
            ask = ask[np.concatenate([[True], ask[1:] != ask[:-1]])]
            said = self._judge(ask // self.m.width, ask % self.m.width)
            ok[new] = said[np.searchsorted(ask, key[new])]
            self.pair_key[slot[new]] = key[new]
            self.pair_ok[slot[new]] = ok[new]
        return ok

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        m = self.m
        out = np.ones(len(left), bool)
        live = np.arange(len(left))
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        end = m.event.shape[1] - 1
        while len(live):
            a, b = left[live], right[live]
            own, other = m.event[a, i], m.event[b, j]
            key = m.tail[a, i] * m.width + m.head[b, j]
            at = np.minimum(np.searchsorted(m.cross_key, key), len(m.cross_key) - 1)
            across = np.where(m.cross_key[at] == key, m.cross_score[at], _NONE)
            bad = (across > own) & (across >= other) & (across > _NONE)
            out[live[bad]] = False
            go = ~bad & ~((own == _NONE) & (other == _NONE))
            first = own >= other
            i, j = np.minimum(i + first, end)[go], np.minimum(j + ~first, end)[go]
            live = live[go]
        return out

    def _matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces in a string of symbols: (start, index of the piece)."""
        present = np.unique(text)
        dense = np.zeros(len(self.single) + 1, np.uint64)
        dense[present] = np.arange(len(present), dtype=np.uint64) + np.uint64(1)
        bits = max(1, int(len(present)).bit_length())
        per = 64 // bits
        n = len(text)
        padded = np.concatenate([dense[text], np.zeros(self.longest + per, np.uint64)])
        key = np.zeros(n + self.longest, np.uint64)
        for k in range(per):
            key = (key << np.uint64(bits)) | padded[k : k + len(key)]
        # the suffix array: by `per` symbols, then by twice as many, until no piece is longer
        order = np.argsort(key[:n])
        depth = per
        while depth < self.longest:
            ranked = key[:n][order] if depth == per else rank[order]
            rank = np.zeros(n + self.longest, np.uint64)
            rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]])).astype(np.uint64)
            rank[:n] = (rank[:n] << np.uint64(32)) | rank[depth : depth + n]
            order = np.argsort(rank[:n])
            rank = rank[:n]
            depth *= 2
        known = (dense[self.spelled] > 0) | (self.spelled == 0)
        which = np.flatnonzero(known.all(axis=1))
        spelled, length = dense[self.spelled[which]], self.length[which]
        levels = -(-self.longest // per)
        wide = np.zeros((len(which), levels * per), np.uint64)
        wide[:, : self.longest] = np.where(self.spelled[which] > 0, spelled, 0)
        lows, masks = [], []
        for level in range(levels):
            low, mask = np.zeros(len(which), np.uint64), np.zeros(len(which), np.uint64)
            for k in range(per):
                low = (low << np.uint64(bits)) | wide[:, level * per + k]
                mask = (mask << np.uint64(bits)) | np.where(level * per + k < length, np.uint64((1 << bits) - 1), np.uint64(0))
            lows.append(low), masks.append(mask)

        def bound(after: bool) -> np.ndarray:
            """The first suffix not below the piece, or the first beyond those that begin with it."""
            a, z = np.zeros(len(which), np.int64), np.full(len(which), n, np.int64)
            while (a < z).any():
                mid = (a + z) >> 1
                at = order[np.minimum(mid, n - 1)]
                less, same = np.zeros(len(which), bool), np.ones(len(which), bool)
                for level in range(levels):
                    have = key[np.minimum(at + level * per, len(key) - 1)] & masks[level]
                    less |= same & (have < lows[level])
                    same &= have == lows[level]
                up = (less | (same & after)) & (a < z)
                z = np.where((a < z) & ~up, mid, z)
                a = np.where(up, mid + 1, a)
            return a

        first, last = bound(False), bound(True)
        count = last - first
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(first - np.concatenate([[0], ends[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)
        return order[at], np.repeat(which, count)

    def _pieces(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, one after another, and where each one's end."""
        m = self.m
        code = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        end = np.cumsum(length + 1) - 1
        begin = end - length
        text = self.symbol[code]
        text[end] = 0
        start, piece = self._matches(text)
        # characters that are no piece are edges too, so that every position is reached
        lone = self.single[text]
        none = np.flatnonzero((text == 0) | ~m.usable[lone] | (lone >= m.n_ids))
        inside = np.ones(len(text), bool)
        inside[end] = False
        none = none[inside[none]]
        symbol = np.concatenate([self.ids[piece], np.where(text[none] == 0, m.width - 1, lone[none])])
        start = np.concatenate([start, none])
        stop = start + np.concatenate([self.length[piece], np.ones(len(none), np.int64)])
        base = np.repeat(begin, length + 1)
        where = stop - base[start]
        by = np.argsort(where.astype(np.uint16) if len(where) == 0 or where.max() < 65536 else where, kind="stable")
        start, stop, symbol, where = start[by], stop[by], symbol[by], where[by]
        last, back = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        opening = np.zeros(len(text) + 1, bool)
        opening[begin] = True
        cuts = np.searchsorted(where, np.arange(1, int(length.max(initial=0)) + 2))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            s, t = start[a:z], symbol[a:z]
            before = last[s]
            open_ = opening[s]
            ok = open_.copy()
            ask = np.flatnonzero(~open_ & (before >= 0))
            ok[ask] = self.follows(before[ask], t[ask])
            last[stop[a:z][ok]], back[stop[a:z][ok]] = t[ok], s[ok]
        # from each segment's end to its beginning
        live, pos = np.flatnonzero(length > 0), end[length > 0]
        parts, seg, step = [], [], []
        k = 0
        while len(live):
            parts.append(last[pos]), seg.append(live), step.append(np.full(len(live), k))
            pos = back[pos]
            more = pos > begin[live]
            live, pos = live[more], pos[more]
            k += 1
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(segments), np.int64)
        parts, seg, step = np.concatenate(parts), np.concatenate(seg), np.concatenate(step)
        by = np.lexsort((-step, seg))
        parts, seg = parts[by], seg[by]
        ids, n = parts, np.ones(len(parts), np.int64)
        rare = np.flatnonzero(parts >= m.n_ids)
        if len(rare):  # characters outside the vocabulary become bytes
            spelt = {}
            firsts = np.concatenate([[True], seg[1:] != seg[:-1]])
            place = np.zeros(len(parts), np.int64)
            width = np.where(parts < m.n_ids, self._widths()[np.minimum(parts, m.n_ids - 1)], 1)
            run = np.cumsum(width) - width
            place = run - np.repeat(run[firsts], np.diff(np.concatenate([np.flatnonzero(firsts), [len(parts)]])))
            for r in rare.tolist():
                spelt[r] = m.byte_ids[list(segments[seg[r]][int(place[r])].encode("utf-8", "replace"))]
                n[r] = len(spelt[r])
            ids = np.repeat(parts, n)
            at = np.cumsum(n) - n
            for r, own in spelt.items():
                ids[at[r] : at[r] + n[r]] = own
        return ids.astype(np.int32), np.cumsum(np.bincount(seg, weights=n, minlength=len(segments)).astype(np.int64))

    def _widths(self) -> np.ndarray:
        if not hasattr(self, "_width"):
            self._width = np.array([len(t) for t in self.m.texts[: self.m.n_ids]], np.int64)
        return self._width

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each one's."""
        if len(self.seen) > SEEN or self.seen.new:  # what a failed batch has left has no pieces
            self.forget()
        # an empty text has no pieces, not even the dummy prefix
        found = [self.pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        count = np.fromiter(map(len, found), np.int64, len(found))
        which = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(found)), np.int64, int(count.sum()))
        if self.seen.new:
            ids, ends = self._pieces(self.seen.new)
            self.at = np.concatenate([self.at, len(self.flat) + ends])
            self.flat = np.concatenate([self.flat, ids])
            self.seen.new = []
        n = self.at[which + 1] - self.at[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[which] - (ends - n), n) + np.arange(total)]
        per = np.cumsum(np.concatenate([[0], count]))
        return ids, np.concatenate([[0], ends])[per]


def decode(model: Model, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The texts that ids spell, without the dummy prefix; control pieces spell nothing."""
    n = model.cover[ids + 1] - model.cover[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    spelt = model.flat[np.repeat(model.cover[ids] - (ends - n), n) + np.arange(total)].tobytes()
    at = np.concatenate([[0], ends])[offsets].tolist()
    return [spelt[a + (spelt[a : a + 1] == b" " and a < z) : z] for a, z in zip(at[:-1], at[1:], strict=True)]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(key: int, model: Model) -> Encoder:
    if key not in _ENCODERS:  # a worker's tasks share it
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, lossless (decoding gives the text back; not so where the text has the mark's own
    character, which comes back as a blank). Null
    and empty texts have no ids and are lossless. Repeated rows give repeated results; a null doc_id stays null; other
    columns are ignored. The model's file is read on the driver."""
    model = load(model_path)
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = hash((model_path, model.n_ids))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(key, held.value)
        for batch in batches:
            for first, data, offsets in common.text_slices(batch.column(1), common.SLICE_BYTES // 2):
                raw = data.tobytes()
                bodies = [raw[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ids, at = own.encode([b.decode("utf-8", "replace") for b in bodies])
                back = decode(held.value, ids, at)
                same = [x == b for x, b in zip(back, bodies, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(bodies)), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "lossless"])

    return common.wanted(docs, doc_id="long", text="string").mapInArrow(encoded, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decoded(rows: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the text that they spell. Null ids give a null text; ids outside the
    vocabulary are an error."""
    model = load(model_path)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, ids)])
            texts = decode(held.value, np.array([i for x in ids for i in x], np.int64), at)
            valid = batch.column(1).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") if v else None for t, v in zip(texts, valid, strict=True)], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(spelt, "doc_id long, text string")
