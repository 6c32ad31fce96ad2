"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier over hashed byte n-grams predicts each bit. A text's margins are
decoded by loss: of all codewords the one with the least sum of weighted losses wins, where a bit weighs by how well its
classifier did on the rows it learned from. A text whose second codeword comes close is flagged as ambiguous.

Classifiers are fitted on at most SAMPLE labelled texts (chosen by the hash of doc_id); all texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The most labelled texts to learn from, the most languages (those with most texts), hashed n-gram features, lengths of n-grams, least part of a probability by
#: which the best codeword has to lead the second.
SAMPLE, LANGUAGES, FEATURES, GRAMS, LEAD = 8_000, 1_000, 1 << 12, (1, 2, 3), 0.2
UNKNOWN = "und"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of n languages. Up to 5: the exhaustive code of 2 ** (n - 1) - 1 bits. More: random
    columns, of which those that set codewords furthest apart are kept."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1] * ((1 << (n - 1)) - 1)]
        for k in range(1, n):
            run = 1 << (n - 1 - k)
            bits.append(([-1] * run + [1] * run) * (1 << (k - 1)))
        return np.array([b[: (1 << (n - 1)) - 1] for b in bits], float)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if near > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    scale: float


def counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of (first row, square roots of n-gram counts scaled to length 1, whether a text has a letter)."""
    mask = np.uint32(FEATURES - 1)
    for first, data, offsets in common.text_slices(column, common.SLICE_BYTES // 2, 512):
        rows = len(offsets) - 1
        low = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8).astype(np.uint32)
        hashed = []
        for n in GRAMS:
            h = np.full(max(0, len(low) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ low[k : len(h) + k]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            hashed.append((h & mask).astype(np.int64))
        letters = np.concatenate([[0], np.cumsum(_IS_LETTER[data])])
        ascii_letter = letters[offsets[1:]] > letters[offsets[:-1]]
        high = np.concatenate([[0], np.cumsum(data > 127)])
        out, alphabetic = np.zeros((rows, FEATURES), np.float32), ascii_letter.copy()
        for r in range(rows):
            a, z = int(offsets[r]), int(offsets[r + 1])
            for n, h in zip(GRAMS, hashed, strict=True):
                if z - a >= n:
                    out[r] += np.bincount(h[a : z - n + 1], minlength=FEATURES)
            if not alphabetic[r] and high[z] > high[a]:
                alphabetic[r] = any(c.isalpha() for c in data[a:z].tobytes().decode("utf-8", "ignore"))
        np.sqrt(out, out=out)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        yield first, out, alphabetic


def fit(x: np.ndarray, language: np.ndarray, languages: list[str], rounds: int = 80) -> Model:
    """Ridge-regularised logistic classifiers of all bits at once, by gradient steps with momentum; each language weighs
    the same."""
    code = codewords(len(languages))
    y = code[language].astype(np.float32)  # in double precision each step would copy x
    weigh = (1 / np.maximum(np.bincount(language, minlength=len(languages)), 1)[language])[:, None].astype(np.float32)
    weigh = weigh / weigh.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -y * weigh / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - 20.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 20.0 * g.sum(axis=0)
        w, b = (w + vw).astype(np.float32), (b + vb).astype(np.float32)
    margin = x @ w + b
    right = ((margin * y > 0) * weigh).sum(axis=0)
    trust = np.clip(right - 0.5, 0.01, None)
    model = Model(languages, code, w, b, trust / trust.sum(), 1.0)
    # the scale of losses at which their softmax fits the labels best
    loss = decode(model, margin)
    scales = np.array([0.5, 1, 2, 4, 8, 16])
    fits = [float((weigh[:, 0] * np.log(np.maximum(_softmax(-s * loss)[np.arange(len(x)), language], 1e-12))).sum()) for s in scales]
    model.scale = float(scales[int(np.argmax(fits))])
    return model


def decode(model: Model, margin: np.ndarray) -> np.ndarray:
    """The weighted loss of each text's margins against each codeword."""
    return np.stack([(np.logaddexp(0, -margin * row) * model.trust).sum(axis=1) for row in model.code], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows with a text and a lang, at most about `sample` of them, of LANGUAGES languages at most; fewer than two languages give a model that
    always says the one, or `und`. Rows without an id are not learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(per)
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32), np.ones(1), 1.0)
    # as many rows of each language, if it has them
    share = F.create_map(*(v for lang, n in per.items() for v in (F.lit(lang), F.lit(int(min(1.0, sample / len(per) / n) * (1 << 20))))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")]).select("lang", "text")

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, _ in counts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    # made by all tasks at once; at most `sample` rows of fixed size, 64 MB in all, come to the driver
    found = common.settled(chosen.mapInArrow(shrunk, "lang string, x binary"), "features").toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    x = [np.frombuffer(v.as_buffer(), np.float16) for v in found.column("x")]
    language = [place[lang] for lang in found.column("lang").to_pylist()]
    if not x:
        return Model([], np.ones((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32), np.ones(1), 1.0)
    return fit(np.array(x, np.float32), np.array(language), languages)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1, the decoded probability of the language), second (the next
    language), ambiguous (the first leads the second by less than LEAD). Texts that are null or have no letter are `und`
    with a score of 0. Repeated rows give repeated results; a null doc_id stays null; other columns are ignored."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("second", T.StringType()), T.StructField("ambiguous", T.BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, UNKNOWN], object)
        n = len(m.languages)
        for batch in batches:
            for first, x, letters in counts(batch.column(1)):
                if n:
                    p = _softmax(-m.scale * decode(m, x @ m.weights + m.bias)).astype(float)
                    by = np.argsort(-p, axis=1, kind="stable")
                    best, second = by[:, 0], by[:, 1] if n > 1 else np.full(len(x), n)
                    score = p[np.arange(len(x)), best]
                    lead = score - (p[np.arange(len(x)), second] if n > 1 else 0)
                else:
                    best = second = np.zeros(len(x), int)
                    score = lead = np.zeros(len(x))
                best, second = np.where(letters, best, n), np.where(letters, second, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(names[second], pa.string()), pa.array(letters & (lead < LEAD))], names=schema.names)

    return common.wanted(docs, doc_id="long", text="string").mapInArrow(told, schema)


def held_out(doc_id) -> F.Column:
    """The rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and tell the language of all: predict()'s columns and held_out. Null ids
    are not learned from, and not held out; ties of scores go to the language that sorts first; an empty table gives none."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
