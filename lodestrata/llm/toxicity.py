"""Toxicity: misspelled lexicon terms by Levenshtein automata over a trie, weighed by the context around each hit.

The lexicon's trie is intersected with the Levenshtein automata of its terms and determinised, so one table walks all
words of a batch at once, a character at a time; words that leave the automaton are dropped from the walk. Terms are
whole words or stems (a stem matches what begins with it). Words of FUZZY letters or more allow one edit, also where a
stem covers them, unless the labelled texts show that what lies an edit away from the word is no sign (it is an ordinary
word, say, or made of the same syllables); shorter ones and stems allow none.

Each hit is then judged by a window of text around it: inside quotation marks or beside a word of reporting it counts
less, beside an address in the second person more, and with an edit less than without. A document's severity is the sum
of its hits, so edits and context move every score in the direction that they stand for, however rare they are among the
labelled texts; a logistic model of severity and density (severity for each word) turns it into a score.

Lexicon and model are learned from labelled rows, at most SAMPLE of them (chosen by the hash of doc_id); the texts of
all documents are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The most labelled rows to learn from; the most lexicon terms of each kind (words, words that a stem covers, stems);
#: letters from which a word allows an edit.
SAMPLE, TERMS, FUZZY = 20_000, 300, 5
#: Toxic documents that must have a string before it counts at all.
LEAST = 4
#: Bytes of text on either side of a hit that make its context.
CONTEXT = 60
STEM = (4, 5, 6, 7)
ADDRESS = re.compile(r"\b(you|your|you're|u|ur|du|ihr|dich|tu|vous|toi|tú|usted|vosotros)\b", re.I)
REPORT = re.compile(r"\b(said|says|quote[ds]?|called|term|word|slur|wrote|sagte|Wort|Zitat|dit|mot|dijo|palabra)\b", re.I)
OPEN, CLOSE = re.compile("[\"“«„‘']\\s*[^\"”»“’'\n]{0,40}$"), re.compile("^[^\"“«„‘'\n]{0,40}[\"”»“’']")
QUOTED, ADDRESSED = 0.35, 1.25
#: What a hit with an edit counts; how many times as frequent in toxic texts as in clean ones a term, and what lies an edit
#: away from it, has to be.
EDITED, TELLS, NEAR_TELLS = 0.8, 20, 3
#: Sums of context weights by kind of hit, and hits in quotation, which are reported; then the model's own features.
SUMS, FEATURES = ("exact", "stem", "fuzzy", "quoted"), ("severity", "density")

_WORD = re.compile(r"[^\W_]+")
#: There are no letters or digits from here on, nor at the code point before.
_TOP = 0x40000
#: Lower-case code points below _TOP.
_LOWER = np.array([ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(_TOP)], np.int64)
_LETTER = np.array([chr(i).isalnum() for i in range(_TOP)])
#: Letters of terms below this code point have columns of their own in the table; the others are kept sparse.
_NEAR = 2048


@dataclass
class Automaton:
    """classes: a class for each code point below _TOP (0: no letter, 1: any other letter). step[state * n + class] for
    classes below n; letters of higher classes step as class 1 does, unless far_keys (state << 32 | class, in order) has
    the pair. State 0 is dead, 1 the start. whole, stem: 0 for none, else 1 + edits at a word's end, or as soon as
    reached."""

    classes: np.ndarray
    step: np.ndarray
    far_keys: np.ndarray
    far_step: np.ndarray
    whole: np.ndarray
    stem: np.ndarray

    def next(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        n = self.step.size // len(self.whole)
        far = np.flatnonzero(cls >= n)
        if not len(far):
            return self.step[state.astype(np.int64) * n + cls]
        out = self.step[state.astype(np.int64) * n + np.where(cls < n, cls, 1)]
        if len(self.far_keys):
            keys = state[far].astype(np.int64) << 32 | cls[far]
            at = np.minimum(np.searchsorted(self.far_keys, keys), len(self.far_keys) - 1)
            out[far] = np.where(self.far_keys[at] == keys, self.far_step[at], out[far])
        return out


def automaton(words: list[str], stems: list[str], fuzzy: int = FUZZY, strict: frozenset[str] = frozenset()) -> Automaton:
    """Levenshtein automata of all terms, intersected with their trie, as one deterministic table. strict: words that allow
    no edit whatever their length."""
    kids: list[dict[str, int]] = [{}]
    ends: list[tuple[int, bool]] = [(-1, False)]  # edits allowed at a word's end, is it a stem
    reach = [False]  # has a term below that allows an edit
    for term, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
        at, edits = 0, 1 if len(term) >= fuzzy and not is_stem and term not in strict else 0
        reach[0] |= bool(edits)
        for c in term:
            if c not in kids[at]:
                kids[at][c] = len(kids)
                kids.append({}), ends.append((-1, False)), reach.append(False)
            at = kids[at][c]
            reach[at] |= bool(edits)
        ends[at] = (max(edits, ends[at][0]), is_stem or ends[at][1])
    letters = sorted({c for k in kids for c in k})  # by code point, so those with columns of their own come first
    of = {c: i + 2 for i, c in enumerate(letters)}
    classes = np.where(_LETTER, 1, 0)
    for c, i in of.items():
        classes[ord(c)] = i
    n = sum(ord(c) < _NEAR for c in letters) + 2

    def closed(found: dict[int, int]) -> frozenset:
        out = dict(found)
        for node, e in found.items():
            if e == 0 and reach[node]:
                for kid in kids[node].values():  # a letter of the term left out
                    if reach[kid] and out.get(kid, 2) > 1:
                        out[kid] = 1
        return frozenset(out.items())

    start = closed({0: 0})
    ids, todo, rows, far = {frozenset(): 0, start: 1}, [start], {0: [0] * n}, {}

    def after(state: frozenset, letter: str | None) -> int:
        found: dict[int, int] = {}
        for node, e in state:
            kid = kids[node].get(letter) if letter else None
            if kid is not None and found.get(kid, 2) > e and (e == 0 or reach[kid]):
                found[kid] = e
            if e == 0 and reach[node]:
                for kid in kids[node].values():  # another letter in its place
                    if reach[kid] and found.get(kid, 2) > 1:
                        found[kid] = 1
                if found.get(node, 2) > 1:  # a letter too many
                    found[node] = 1
        new = closed(found)
        if new not in ids:
            ids[new] = len(ids)
            todo.append(new)
        return ids[new]

    while todo:
        state = todo.pop()
        other = after(state, None)  # of all letters but those that go on from here
        row = [0] + [other] * (n - 1)
        for letter in sorted({c for node, _ in state for c in kids[node]}):
            if of[letter] < n:
                row[of[letter]] = after(state, letter)
            else:
                far[ids[state] << 32 | of[letter]] = after(state, letter)
        rows[ids[state]] = row
    far_keys = np.array(sorted(far), np.int64)
    whole, stem = np.zeros(len(ids), np.int8), np.zeros(len(ids), np.int8)
    for state, i in ids.items():
        for node, e in state:
            allowed, is_stem = ends[node]
            if e <= allowed and (not whole[i] or e + 1 < whole[i]):
                whole[i] = e + 1
            if is_stem and e == 0:
                stem[i] = 1
    step = np.array([rows[i] for i in range(len(ids))], np.int32).ravel()
    return Automaton(classes[_LOWER].astype(np.uint16), step, far_keys, np.array([far[k] for k in far_keys.tolist()], np.int32), whole, stem)


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 characters whose first bytes are at lead."""
    code = data[lead].astype(np.int64)
    for least, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        own = np.flatnonzero((data[lead] >= least) & (data[lead] < (0xE0, 0xF0, 0x100)[size - 2]))
        if len(own):
            value = code[own] & (0x7F >> size)
            for k in range(1, size):
                value = value << 6 | data[np.minimum(lead[own] + k, len(data) - 1)] & 0x3F
            code[own] = value
    return code


def hits(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hits of a slice as (row, first byte, byte after, kind), kind 0 exact, 1 stem, 2 fuzzy; and words of each row."""
    rows = len(offsets) - 1
    none = np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return none, none, none, none, np.zeros(rows, np.int64)
    cls = auto.classes[np.minimum(code_points(data, lead), _TOP - 1)]
    inside = cls != 0
    edge = np.searchsorted(lead, offsets)  # where rows begin, in characters
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = edge[:-1][edge[:-1] < len(cls)]
    opens[heads] = inside[heads]
    closes = np.empty_like(inside)
    closes[:-1] = inside[:-1] & (~inside[1:] | opens[1:])
    closes[-1] = inside[-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(edge, start, side="right") - 1
    n_words = np.bincount(row, minlength=rows)
    state, live, at = np.ones(len(start), np.int32), np.arange(len(start)), start.copy()
    got_word, got_kind = [], []
    while len(live):
        state = auto.next(state, cls[at])
        alive = state > 0
        state, live, at = state[alive], live[alive], at[alive] + 1
        stem = auto.stem[state] > 0
        over = (at == end[live]) & ~stem
        whole = over & (auto.whole[state] > 0)
        got_word += [live[stem], live[whole]]
        got_kind += [np.ones(int(stem.sum()), np.int64), np.where(auto.whole[state[whole]] == 1, 0, 2)]
        go = ~stem & ~over
        state, live, at = state[go], live[go], at[go]
    word, kind = (np.concatenate(x) if x else none for x in (got_word, got_kind))
    by = np.argsort(word, kind="stable")
    word, kind = word[by], kind[by]
    last = end[word]
    return row[word], lead[start[word]], np.where(last < len(lead), lead[np.minimum(last, len(lead) - 1)], len(data)), kind, n_words


def context_weight(before: str, after: str) -> float:
    """How much a hit counts: QUOTED inside quotation marks or beside a word of reporting, ADDRESSED beside an address."""
    if (OPEN.search(before) and CLOSE.search(after)) or REPORT.search(before):
        return QUOTED
    return ADDRESSED if ADDRESS.search(before) or ADDRESS.search(after) else 1.0


def features(auto: Automaton, column: pa.Array) -> np.ndarray:
    """One row of SUMS and FEATURES for each text."""
    n = len(SUMS)
    out = np.zeros((len(column), n + len(FEATURES)))
    for first, data, offsets in common.text_slices(column):
        row, begin, end, kind, n_words = hits(auto, data, offsets)
        for r, a, z, k in zip(row.tolist(), begin.tolist(), end.tolist(), kind.tolist(), strict=True):
            before = data[max(offsets[r], a - CONTEXT) : a].tobytes().decode("utf-8", "ignore")
            after = data[z : min(offsets[r + 1], z + CONTEXT)].tobytes().decode("utf-8", "ignore")
            w = context_weight(before, after)
            out[first + r, k] += w
            out[first + r, 3] += w == QUOTED
        own = slice(first, first + len(n_words))
        out[own, n] = out[own, 0] + out[own, 1] + EDITED * out[own, 2]
        out[own, n + 1] = out[own, n] / np.maximum(n_words, 1) * 100
    out[:, n:] = np.log1p(out[:, n:])
    return out


def _less(word: str) -> set[str]:
    return {word} | {word[:k] + word[k + 1 :] for k in range(len(word))}


def _one_edit(a: str, b: str) -> bool:
    """Whether one edit at most makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def nearby(words: list[str]) -> dict[str, list[str]]:
    """Words by what is left of each without one of its letters or none."""
    found: dict[str, list[str]] = {}
    for w in words:
        for x in _less(w):
            found.setdefault(x, []).append(w)
    return found


def terms_near(index: dict[str, list[str]], word: str) -> set[str]:
    """The words of the index that are one edit away."""
    return {w for x in _less(word) for w in index.get(x, ()) if w != word and _one_edit(w, word)}


def fewest(n_toxic: int) -> int:
    """The toxic documents that must have a string before it can be a term."""
    return max(LEAST, n_toxic // 50)


def lexicon(words: dict[str, tuple[int, int]], families: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, most: int = TERMS) -> tuple[list[str], list[str]]:
    """Words and stems that mark toxic texts. words: strings (stems with a * at their end) with the numbers of toxic and
    clean documents that have them. families: by stem, how many longer words of LEAST toxic documents or more begin with
    it, and in how many the most frequent word is that does, or is the stem itself."""
    least = fewest(n_toxic)
    tells = {w: (a, c) for w, (a, c) in words.items() if a >= least and a / max(n_toxic, 1) >= TELLS * (c + 0.05) / max(n_clean, 1)}
    stems: list[str] = []
    for w in sorted((w for w in tells if w.endswith("*")), key=lambda w: (len(w), w)):
        completions, largest = families.get(w, (0, 0))
        if completions >= 5 and not any(w.startswith(s) for s in stems):
            if largest < 0.7 * tells[w][0]:  # else one word makes up the stem
                stems.append(w[:-1])
    stems = stems[:most]
    of_stem = lambda w: any(w.startswith(s) for s in stems)
    often = sorted((w for w in tells if not w.endswith("*")), key=lambda w: (-tells[w][0], w))
    # a stem allows no edit, so the words behind it stay as terms that do; each of the three kinds has its own bound
    plain = [w for w in often if not of_stem(w)][:most] + [w for w in often if len(w) >= FUZZY and of_stem(w)][:most]
    return sorted(plain), sorted(stems)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 60) -> np.ndarray:
    """Weights, the bias last, by damped Newton steps; the two classes weigh the same. Severity and density can only raise
    a score: one that would lower it is left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = _newton(x * used, y, ridge, rounds)
        lower = used & (w[:-1] < 0)
        if not lower.any():
            return w
        used &= ~lower


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    sample = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    w = np.zeros(x.shape[1])
    pull = np.array([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (sample * (p - y)) + pull * w
        hess = (x * (sample * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    strict: frozenset[str]
    weights: np.ndarray

    def automaton(self) -> Automaton:
        return automaton(self.words, self.stems, strict=self.strict)


def _strings(text: str) -> set[str]:
    found = set(_WORD.findall(text.lower()))
    return {w for w in found if 3 <= len(w) <= 40 and not w.isdigit()} | {f"{w[:k]}*" for w in found for k in STEM if len(w) >= k and not w.isdigit()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents, at most about `sample` of them. Rows without a label, a text or an id don't count;
    of several labels for an id the highest counts; equal texts count once. Without any, all scores are 0.5 or less."""
    given = common.wanted(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, given.count()))
    given = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = common.wanted(docs, doc_id="long", text="string").where("text IS NOT NULL")
    own = common.settled(texts.join(F.broadcast(given), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).dropDuplicates(["text"]).repartition(24), "labelled")

    def tell(batches: Iterator[pa.RecordBatch], toxic: bool, only: frozenset | None) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(_strings(text) if only is None else _strings(text) & only)
                n += 1
        count[""] = n
        yield pa.RecordBatch.from_pydict({"w": list(count), "n": list(count.values())}, schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))

    summed = lambda toxic, only: own.where(f"toxic = {int(toxic)}").select("text").mapInArrow(lambda b: tell(b, toxic, only), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = common.settled(summed(True, None).where(f"n >= {LEAST} OR w = ''"), "strings")
    n_toxic = counts.where("w = ''").agg(F.sum("n")).first()[0] or 0
    # what can be a term is in a fiftieth of the toxic texts or more, so it is 50 times an average text's strings at most
    often = counts.where(f"w <> '' AND n >= {fewest(n_toxic)}")
    bad = {r.w: r.n for r in often.collect()}
    whole = counts.where("w <> '' AND w NOT LIKE '%*'").select("w", "n", F.explode(F.array(*map(F.lit, STEM))).alias("k")).where("length(w) >= k")
    behind = whole.groupBy(F.expr("concat(substring(w, 1, k), '*')").alias("w")).agg(F.count_if(F.expr("length(w) > k")).alias("longer"), F.max("n").alias("largest"))
    families = {r.w: (r.longer, r.largest) for r in often.select("w").join(behind.where("longer > 0"), "w").collect()}
    good = {r.w: r.n for r in summed(False, frozenset(bad)).collect()}
    n_clean = good.pop("", 0)
    words, stems = lexicon({w: (a, good.get(w, 0)) for w, a in bad.items()}, families, n_toxic, n_clean)
    loose = automaton(words, stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many toxic and clean texts something an edit away from each word stands, as a hit of its own."""
        index = nearby([w for w in words if len(w) >= FUZZY])
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for first, data, offsets in common.text_slices(batch.column(0)):
                row, begin, end, kind, _ = hits(loose, data, offsets)
                own: dict[int, set[str]] = {}
                for r, a, z in zip(row[kind == 2].tolist(), begin[kind == 2].tolist(), end[kind == 2].tolist(), strict=True):
                    own.setdefault(r, set()).update(terms_near(index, data[a:z].tobytes().decode("utf-8", "ignore").lower()))
                for r, terms in own.items():
                    seen[toxic[first + r]].update(terms)
        yield pa.RecordBatch.from_pydict({"w": [w for k in (0, 1) for w in seen[k]], "toxic": [k for k in (0, 1) for _ in seen[k]], "n": [n for k in (0, 1) for n in seen[k].values()]}, schema=pa.schema([("w", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    # two rows for each word of the lexicon at most
    around = {(r.w, r.toxic): r.n for r in own.mapInArrow(near, "w string, toxic int, n long").groupBy("w", "toxic").agg(F.sum("n").alias("n")).collect()} if words else {}
    strict = frozenset(w for w in words if (around.get((w, 1), 0) + 0.5) / max(n_toxic, 1) < NEAR_TELLS * (around.get((w, 0), 0) + 0.05) / max(n_clean, 1))
    auto = automaton(words, stems, strict=strict)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(auto, batch.column(0))[:, len(SUMS) :]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = own.mapInArrow(measured, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()  # at most `sample`
    if not rows or len({r.toxic for r in rows}) < 2:
        return Model([], [], frozenset(), np.array([0.0] * len(FEATURES) + [-4.0]))
    times = np.array([r["count"] for r in rows])
    return Model(words, stems, strict, logistic(np.repeat(np.array([r.x for r in rows]), times, axis=0), np.repeat(np.array([float(r.toxic) for r in rows]), times)))


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x[:, len(SUMS) :] @ weights[:-1] + weights[-1], -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score (0 to 1), n_exact, n_stem, n_fuzzy (sums of context weights), n_quoted (hits in
    quotation). Null and empty texts, and those without a hit, get the model's score for no hit. Repeated rows give
    repeated results; a null doc_id stays null; other columns are ignored."""
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in ("score", "n_exact", "n_stem", "n_fuzzy", "n_quoted")])
    held = docs.sparkSession.sparkContext.broadcast((model.automaton(), model.weights))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, weights = held.value
        for batch in batches:
            x = features(auto, batch.column(1))
            p = _probability(x, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), *(pa.array(x[:, k]) for k in range(len(SUMS)))], names=schema.names)

    return common.wanted(docs, doc_id="long", text="string").mapInArrow(scored, schema)


def held_out(doc_id) -> F.Column:
    """The rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of rows that are not held out, and score all documents: score()'s columns, held_out and
    predicted (1 if score >= 0.5, else 0)."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def tolerable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns; each row is judged by its own text, so repeated rows
    stay or go alike. Null and empty texts have no hit: they stay, as all does if there are no labels of both kinds."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    held = docs.sparkSession.sparkContext.broadcast((model.automaton(), model.weights))

    def fine(texts: pa.Array) -> np.ndarray:
        auto, weights = held.value
        return _probability(features(auto, texts), weights) < 0.5

    return common.kept(docs, fine)
