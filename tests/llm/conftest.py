from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _node int, _size string, count int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long_text = "".join(f"line {n} of a very long text, word{n * 7919 % 1000}\n" for n in range(20000))
    rows = [
        (1, "plain words stand here and they are many enough", "en", "a", 46),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (None, "a row without an id keeps its words", "de", None, 5),
        (5, long_text, "en", "b", len(long_text)),
        (6, "plain words stand here and they are many enough", "en", "a", 46),
        (6, "plain words stand here and they are many enough", "en", "a", 46),
        (6, "the same id with another text", "en", "c", 29),
        (8, "\n\n \n", "fr", "c", 4),
        (9, "word", "fr", "c", 4),
        (10, "\U0001f600 Ünïcödé ΑΣ 'S don't \x1c x\x85y", "fr", "c", -1),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame([(*row, "x", 1, "y", 2) for row in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
