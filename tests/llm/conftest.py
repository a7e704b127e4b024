from __future__ import annotations

import pytest

#: Nulls, empty, blank, very long, repeated and tied rows, control strings.
TEXTS = [None, "", " \t\n ", "one", "One two three", "a b c d e f g h", "a b c d e f g h", "x<|endoftext|>y <|im_end|> <\\|im", "é" * 300 + " à", "word " * 5000 + "end", "日本 語", "12 34 !!"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, one doc_id null and one twice, with columns that clash with ours."""
    rows = [(k if k else None, t, "en" if k % 2 else None, "s", len(t or ""), 1.5, "k") for k, t in enumerate(TEXTS)] + [(4, "One two three", "en", "s", 13, 0.0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, `a.b` string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def some(spark):
    """A few hundred real documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
