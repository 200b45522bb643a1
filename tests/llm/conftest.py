"""Small awkward tables shared by the operator tests."""

import pytest
from pyspark.sql import functions as F

WORDS = "river stone cloud window garden letter market silver bridge candle forest mirror".split()
LONG = " ".join(f"{WORDS[i % 12]}{i % 997}" for i in range(40_000))

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b"),
    (3, None, None, None),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\r\n\x0b\x0c ", "fr", "a"),
    (6, "one", "fr", "a"),
    (7, LONG, "en", "a"),
    (8, "x" * 200_000, "en", None),
    (9, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", None, "b"),
    (10, "é ñ ß 日本 😀     end", "de", "c"),
    (None, "a text without an id", "en", "a"),
    (None, "a text without an id", "en", "a"),
    (None, None, "en", "a"),
]
#: Names that the operators use themselves.
CLASHES = ["node", "band", "digest", "score", "predicted", "host", "key", "line", "weight", "tokens", "a", "b", "u", "v",
           "_row", "_key", "_id", "_md5", "_w", "_l", "_range", "_guest", "_to", "i", "j", "c", "n", "members",
           "payload", "topic", "sampled", "probability", "ids", "toxic", "held_out", "text_md5", "component"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASHES:
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
