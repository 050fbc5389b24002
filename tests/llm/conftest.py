import pytest

LONG = "wide river " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 6, "en", 7.0, "x"),
        (2, "The quick brown fox jumps over the lazy dog. " * 6, "en", 7.0, "x"),
        (2, "The quick brown fox jumps over the lazy dog. " * 6, "en", 7.0, "x"),
        (3, None, None, None, None),
        (4, "", "en", 0.0, ""),
        (5, "  \n\t \r\n ", "en", 0.0, ""),
        (6, LONG, "en", 1.0, "y"),
        (None, "a row without an id", "en", 1.0, "y"),
        (None, None, None, None, None),
        (7, "12345 !!! --- é́ 中文 \U0001f600 <|endoftext|> tail", "en", 1.0, "z"),
        (8, "one two", "en", 1.0, "z"),
        (9, "ONE TWO", "en", 1.0, "z"),
        (10, "x" * 30_000, "en", 1.0, "z"),
        (11, "Licensed under the Apache License, Version 2.0.", "en", 1.0, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, N_TOKENS string").withColumnsRenamed({"score": "n_bytes"})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id > 1000")
