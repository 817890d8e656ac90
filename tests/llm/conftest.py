import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, digest string, blob string, size long, key string"


def docs_frame(spark, rows, schema=SCHEMA):
    """(doc_id, text[, source]) rows with columns whose names clash with the operators' own."""
    full = [(i, t, "en", s[0] if s else "a", len(t or ""), "p", "d", "b", 1, "k") for i, t, *s in rows]
    return spark.createDataFrame(full, schema)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and sources, empty and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    long = "\n".join(prose(rng, 40) for _ in range(400))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "alpha beta"), (None, None), (4, "alpha beta"), (4, "alpha beta"), (5, "alphabeta"), (6, long), (7, long + " x"), (8, "é ß wörd\x00nul", None)]
    rows += [(10 + i, "\n".join(prose(rng, rng.randint(1, 30)) for _ in range(4)), rng.choice(["a", "b", None])) for i in range(30)]
    return docs_frame(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_frame(spark, [])
