from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("row", "key", "kept", "score", "size", "n", "hash", "node", "component", "label")


@pytest.fixture
def documents(spark):
    """A table of documents from pairs of id and text; sources go round."""

    def make(rows, extra: bool = False):
        full = [(i, t, "en", None if k % 5 == 4 else f"s{k % 5}", len(t or "")) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA)
        # Columns named like those that operators add for themselves.
        return df.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(CLASHES)]) if extra else df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, ties and repeated rows, a text much longer than others."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(30_000)]
    long = " ".join(words)
    some = " ".join(words[:90])
    return [
        (1, some), (2, some), (2, some), (None, some), (None, None), (3, None), (4, ""), (4, ""), (5, " \t\n "),
        (6, "one"), (7, "one two three"), (8, long), (9, " ".join(words[:89])), (10, "É̈ 日本語 \U0001f600 " * 30),
    ]
