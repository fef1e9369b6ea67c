from __future__ import annotations

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, row int, key string, pos int, place int, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns named like our own."""
    words = " ".join(f"word{i % 97}x{i % 89}" for i in range(30_000))
    shared = " ".join(f"shared{i}" for i in range(40))
    texts = [
        (1, f"{shared} alpha beta\nLong enough line here\nshort"),
        (2, f"other words first {shared}\n LONG enough line here \nshort"),
        (2, f"other words first {shared}\n LONG enough line here \nshort"),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (None, f"{shared} tail of the null one"),
        (6, words),
        (7, words + " and a bit more"),
        (8, "mit license general public license mit license"),
        (9, "é" * 12 + "\n" + "É" * 12 + "\n\n"),
        (10, "one two three"),
    ]
    rows = [(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None, "x", k, None, 5, 6, "l") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
