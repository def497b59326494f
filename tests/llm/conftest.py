import random

import pytest
from pyspark.sql import types as T

#: A documents table with more columns, under names that operators might use themselves.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        *[T.StructField(x, T.StringType()) for x in ("hash", "norm", "n", "size", "copies", "fp", "part", "key", "label", "length", "start", "kept", "score")],
    ]
)


def words(seed, n, size=400, repeat=0):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(size)]
    return [r.choice(vocab) for _ in range(n)]


@pytest.fixture(scope="session")
def make(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""

    def build(rows, schema=SCHEMA):
        filled = [(*r, *[None] * (4 - len(r)), *["x"] * (len(schema) - 4)) for r in rows]
        return spark.createDataFrame(filled, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, ties, repeated rows, one very long text."""
    long = " ".join(words(7, 30_000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n\x0b\x0c\r ", "en", "a"),
        (4, "a", None, "b"),
        (5, "One two\nthree  four\n\nOne two\n", "en", "b"),
        (5, "One two\nthree  four\n\nOne two\n", "en", "b"),
        (6, " One two three four One two", "en", None),
        (7, "One two three four One two ", "en", None),
        (8, long, "en", "a"),
        (9, long, "en", "a"),
        (10, "é ß 日本語 İ \xa0x\x1cy </s>", "fr", "c"),
        (11, "1234 5678 ###", None, "c"),
        (12, "De " * 100, "fr", "c"),
        (None, "no id here", "en", "a"),
    ]
