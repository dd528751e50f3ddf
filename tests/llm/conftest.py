import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = {
    "en": "the and of to in that is was for with on as are this from have they which one were all their there been".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden aus".split(),
}

#: Columns of documents and some whose names operators add.
SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
    ("score", T.StringType()), ("n", T.IntegerType()), ("label", T.StringType()), ("ids", T.StringType()), ("group", T.LongType()),
)])


def words(seed: int, n: int, lang: str = "en") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, None, "y", 7)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing columns."""
    long = words(3, 60_000)
    rows = [
        row(1, words(1, 40)), row(2, words(1, 40)), row(3, None), row(4, ""), row(5, " \n\t "), row(6, "漢字 é 😀"), row(7, long), row(8, long + " end"),
        row(9, "12 34 !"), row(None, words(1, 40)), row(None, None), row(10, words(5, 30, "de"), "de", None), row(11, words(6, 50, "de"), None, "b"),
        row(12, "one two three"), row(13, "One  TWO\nthree"), row(1, words(1, 40)), row(14, "\x00a b"), row(15, "x" * 5000),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
