"""Term counts and pooled vectors move little and give the plain results."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from trilith.operators import text as T


def _docs(spark):
    rows = [(1, ["a", "b", "a", "b"]), (2, []), (1, ["b", "c"]), (None, ["a"]), (None, ["a", "c", "d"]), (3, None),
            (4, ["x"]), (5, ["a", None, "b"])]
    return spark.createDataFrame(rows, "doc int, tokens array<string>").repartition(3), rows


@pytest.mark.parametrize("span", [(1, 1), (1, 2), (2, 3)])
def test_counts_of_repeated_null_and_empty_documents(spark, monkeypatch, span):
    monkeypatch.setattr(T, "FLUSH", 2)
    df, rows = _docs(spark)
    want: Counter = Counter()
    for doc, words in rows:
        for n in range(span[0], span[1] + 1):
            for i in range(len(words or []) - n + 1):
                part = words[i:i + n]
                want[doc, part[0] if n == 1 else " ".join(w for w in part if w is not None)] += 1
    got = T.term_counts(df, "doc", "tokens", span).collect()
    assert {(r["doc"], r["term"]): r["tf"] for r in got} == want and len(got) == len(want)


def test_only_tokens_are_shuffled(spark):
    df, _ = _docs(spark)
    plan = T.ngrams(df, "doc", "tokens", (1, 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan


def test_pooled_vectors_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    df, _ = _docs(spark)
    vectors = T.hashed_word_vectors(spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "word string"), 4)

    def pooled():
        rows = T.mean_pool(df, "doc", "tokens", vectors, 4).select("doc", F.transform("vec", lambda v: F.round(v, 9)))
        return sorted(map(tuple, rows.collect()), key=repr)

    want = pooled()
    monkeypatch.setattr(T, "HOT_VALUES", 8)  # two words are broadcast
    assert pooled() == want and len(want) == 8


def test_text_udf_sees_few_texts_at_once(spark):
    import pandas as pd

    from trilith.functions.udf import text_udf
    from trilith.session import ARROW_ROWS
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    size = text_udf(lambda s: pd.Series([len(s)] * len(s)), "int")
    seen = spark.range(0, 3000, 1, 1).select(size(F.col("id").cast("string")).alias("n")).agg(F.max("n")).first()[0]
    assert seen <= ARROW_ROWS
