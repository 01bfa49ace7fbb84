import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """docs(texts or (id, text) pairs): a table of documents."""

    def make(texts, parts=3):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        full = [(i, t, "en" if (i or 0) % 3 else None, "web" if (i or 0) % 2 else "books", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture
def words():
    """words(n, seed): a made-up text of n words."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))

    return make
