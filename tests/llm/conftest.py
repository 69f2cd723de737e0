from __future__ import annotations

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCUMENT = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()), StructField("_words", IntegerType()),
    StructField("payload", StringType()), StructField("size", IntegerType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text, source) rows; further columns have names that operators use inside."""
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 7, "x", 1) for i, t, s in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and blank texts, repeated rows, ties and a very long text."""
    passage = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"t{i % 9973}x{i}" for i in range(30000))
    rows = [
        (1, passage, "a"), (2, "before it " + passage + " after it", "a"), (2, "before it " + passage + " after it", "a"),
        (3, None, "b"), (None, passage, None), (4, "", "b"), (5, " \t\n ", None), (6, long, "b"), (7, long + " End", "c"),
        (8, "é 漢字 scum\x0bfoo", "c"), (9, "one two three", "a"), (10, "ONE two three", "a"), (11, "same " * 200, "c"),
    ]
    return documents(rows)
