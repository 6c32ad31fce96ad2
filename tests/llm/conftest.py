import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, root string, size string, id string"


def prose(seed, n, words=("the", "of", "and", "stone", "river", "cloud", "über", "étoile", "niño", "glass", "paper", "seven")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed", "ing", ".", ","]) for _ in range(n))


def odd_texts():
    """Nulls, empty and blank texts, one word, no letters, copies, near copies, repeated rows and a very long text."""
    base = prose(1, 120)
    near = base.replace("stone", "stones", 1)
    texts = [None, "", "   \n", "word", "12 34 --", base, base, near, base.upper(), base + " end", prose(2, 300), prose(3, 8), prose(3, 8) + " x", "a\tb\x00c ▁ d", prose(4, 60_000), "\u00a0é ß 漢字 😀", near + " more words at the very end of it"]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", len(t or ""), "r", "o", "s", "i") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, "en", None, 1, "r", "o", "s", "i")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_texts(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
