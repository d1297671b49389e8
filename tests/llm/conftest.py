from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, payload string, rank double, key string"


def messy_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd white space, special strings."""
    words = "the cat sat on a mat and looked at it for some time while rain fell over the old town".split()
    long = " ".join(words[i * 7 % len(words)] + str(i % 11) for i in range(30_000))
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, "   ", "en", "a", 3), (3, "one", None, "b", 3),
        (4, " ".join(words), "en", "b", 10), (5, " ".join(words), "en", "b", 10), (5, " ".join(words), "en", "b", 10),
        (6, long, "en", None, None), (7, " ".join(words[:-1] + ["village"]), "en", "c", 1),
        (8, "tabs\tand \n breaks\n\n\nhere  two spaces \x1c end ", "en", "c", 1),
        (9, "a special <|endoftext|> string<|endoftext|>", "en", "c", 1), (10, "Ünïcödé 漢字 \U0001F600 it's we'll 1²½ ☃", "de", "a", 1),
        (None, "no id at all but some words", "fr", "a", 1), (12, "x" * 5000, "fr", "a", 1), (13, "zero\0byte\0 text", "fr", "a", 1),
    ]
    return [(*r, 7, "p", 0.5, "k") for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
