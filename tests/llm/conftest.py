from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(4)
    v = [f"wort{i}" for i in range(400)]
    long = " ".join(r.choice(v) for _ in range(30_000))
    rows = [
        (1, None, "en", "a", 0, 1, "x"),
        (2, "", "en", None, 0, None, None),
        (3, " \n\t ", None, "a", 3, 1, "x"),
        (4, "One", "en", "a", 3, 1, "x"),
        (5, "one", "de", "a", 3, 1, "x"),
        (6, long, "en", "a", len(long), 1, "x"),
        (7, long, "en", "a", len(long), 1, "x"),
        (8, "the cat is on the mat and the dog is in the house " * 12, "en", "a", 1, 1, "x"),
        (8, "the cat is on the mat and the dog is in the house " * 12, "en", "a", 1, 1, "x"),
        (9, "Ein Hund <|endoftext|> über äöü 123 $$$", "de", "a", 1, 1, "x"),
        (None, "no id at all", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
