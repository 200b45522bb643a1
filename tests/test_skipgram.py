"""Word vectors trained by parts: like words come together, little is kept."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilith.operators import skipgram as S
from trilith.operators import text as T
from trilith.session import dropped, ensure_checkpoint_dir, scratch_path, written


def _texts(spark, n=400):
    rng = random.Random(3)
    groups = [["red", "green", "blue", "black"], ["cat", "dog", "horse", "bird"]]
    rows = [(i, [rng.choice(groups[i % 2]) for _ in range(30)]) for i in range(n)]
    rows += [(n, ["once"]), (n + 1, []), (n + 2, None), (n + 3, [None, "red", None])]
    return spark.createDataFrame(rows, "doc int, tokens array<string>").repartition(4), groups


@pytest.mark.parametrize("parts", [1, 3])
def test_vectors_of_all_frequent_words_and_no_other(spark, monkeypatch, parts):
    monkeypatch.setattr(S, "SEGMENT", 500)
    df, groups = _texts(spark)
    got = {r["word"]: np.array(r["vec"]) for r in T.word2vec(df, "tokens", dim=16, epochs=2, partitions=parts).collect()}
    assert set(got) == {w for g in groups for w in g}
    assert all(v.shape == (16,) and np.isfinite(v).all() and v.any() for v in got.values())


def test_words_of_one_kind_are_alike():
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(400, dtype=np.int32), 30)
    codes = (rng.integers(0, 20, len(doc)) + 20 * (doc % 2)).astype(np.int32)
    start = S._start([f"w{i}" for i in range(40)], 16, 42)
    u, v = start[:, :16].copy(), start[:, 16:].copy()
    for _ in range(10):
        S.train_part(u, v, codes, doc, 5, lambda done: 0.025, rng)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    like = u @ u.T
    assert like[:20, :20].mean() > like[:20, 20:].mean() + 0.3


def test_segments_hold_every_token_in_order(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 100)
    df, _ = _texts(spark, 50)
    got = []
    for r in S._segments(df, "tokens").collect():
        words = [r["words"][c] for c in r["codes"]]
        assert r["n"] == len(words) and [words.count(w) for w in r["words"]] == r["counts"]
        got += [words[a:b] for a, b in zip([0] + r["ends"], r["ends"])]
    want = [[w for w in r["tokens"] if w is not None] for r in df.where("size(tokens) > 0").collect()]
    assert sorted(got) == sorted(want)


def test_the_driver_holds_no_vectors(spark):
    plan = T.word2vec(_texts(spark)[0], "tokens", dim=4, epochs=2)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "LocalTableScan" not in plan and "ExistingRDD" not in plan


def test_sums_of_repeated_rows():
    to = np.zeros((4, 2), dtype=np.float32)
    S._add(to, np.array([1, 3, 1, 1, 1, 0]), np.ones((6, 2), dtype=np.float32))
    assert np.allclose(to, [[1, 1], [2, 2], [0, 0], [1, 1]])


def test_no_frequent_word_is_an_error(spark):
    with pytest.raises(ValueError):
        T.word2vec(spark.createDataFrame([(["a", "b"],)], "tokens array<string>"), "tokens")


def test_old_tables_are_removed(spark):
    base = ensure_checkpoint_dir(spark).removeprefix("file:") + "/tables"

    def tables():
        return {n for n in os.listdir(base) if n.startswith("w2v-")} if os.path.isdir(base) else set()
    before = tables()
    T.word2vec(_texts(spark)[0], "tokens", dim=4, epochs=3)
    assert len(tables() - before) == 2  # segments and the last vectors


def test_a_write_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(key, "false")
    path = scratch_path(spark, "cleaned-test")
    dropped(spark, path)
    assert written(spark.range(1000).repartition(3, F.col("id")), path).count() == 1000
    assert spark.conf.get(key) == "false"
