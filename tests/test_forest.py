"""Histogram forests against plain loops, and the forest queries' operators."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trilith.operators import forest as H
from trilith.operators import models as M


def _rows(n=500):
    draw = np.random.default_rng(3)
    x = draw.integers(1, 9, (n, 4)).astype(np.uint8)
    return x, ((x[:, 0] > 4).astype(int) + (x[:, 1] > x[:, 2])).astype(np.int64)


@pytest.mark.parametrize("classes", [3, 0])
def test_sums_and_best_split_are_those_of_plain_loops(classes):
    x, y = _rows()
    label = y if classes else y - y.mean()
    trees = H.Trees(2, 3, classes or 2)
    trees.feature[1, 0], trees.cut[1, 0] = 3, 4
    open_ = np.array([1, 2])
    chosen = H.drawn(7, 1, 1, 4, 2)
    assert all(len(set(c)) == 2 for c in chosen.tolist())
    found = H.block_sums(x, label, 5, trees, 1, 1, open_, chosen, classes, 10, 7)
    bits = np.random.Generator(np.random.SFC64([7, 1, 5])).integers(0, 65_536, len(x), dtype=np.uint16)
    weight = H.WEIGHTS[bits]
    want = np.zeros_like(found)
    for r, l, w in zip(x, label, weight):
        node = int(r[3] > 4)
        for j, f in enumerate(chosen[node]):
            want[(j, node, r[f], l) if classes else (j, node, r[f])] += w if classes else np.array([w, w * l])
    assert np.allclose(found, want)

    feature, cut, left, right = H.best(found, chosen, classes)
    for node in (0, 1):
        own = (x[:, 3] > 4) == node

        def impurity(part):
            w = weight[part]
            if classes:
                return w.sum() - sum(w[label[part] == c].sum() ** 2 for c in range(3)) / w.sum()
            return (w * label[part] ** 2).sum() - (w * label[part]).sum() ** 2 / w.sum()

        tried = {}
        for f in chosen[node].tolist():
            for c in range(1, 9):
                low, high = own & (x[:, f] <= c), own & (x[:, f] > c)
                if weight[low].sum() and weight[high].sum():
                    tried[f, c] = impurity(low) + impurity(high)
        assert tried[feature[node], cut[node]] == pytest.approx(min(tried.values()))
        assert np.allclose(left[node] + right[node], found[0, node].sum(axis=0))


def test_weights_are_poisson():
    assert H.WEIGHTS.mean() == pytest.approx(1, abs=1e-3)
    assert (H.WEIGHTS == 0).mean() == pytest.approx(np.exp(-1), abs=1e-4)


def _table(spark, n=3000):
    df = spark.range(n, numPartitions=3).select("id", *[F.rand(i).alias(f"c{i}") for i in range(4)])
    df = df.withColumn("label", (F.col("c0") > 0.5).cast("int") + (F.col("c1") > F.col("c2")).cast("int"))
    return df.withColumn("features", array_to_vector(F.array("c0", "c1", "c2", "c3"))).checkpoint()


def test_forest_learns_all_rows_and_leaves_out_nulls(spark):
    df = _table(spark)
    odd = df.withColumn("label", F.lit(None).cast("int")).limit(50)
    model = M.clf_forest(df.where("id % 3 <> 0").unionByName(odd), n_trees=20)
    assert isinstance(model, H.Forest) and model.trees.value[0, 0].sum() == pytest.approx(1)
    out = model.transform(df.where("id % 3 = 0"))
    assert out.where("prediction = label").count() > 0.93 * out.count()
    p = out.first()["probability"].toArray()
    assert len(p) == 3 and p.sum() == pytest.approx(1)


def test_regression_forest_and_a_label_without_spread(spark):
    df = _table(spark).withColumn("label", 100 + F.col("c0") * F.col("c1"))
    out = M.reg_forest(df.where("id % 3 <> 0"), n_trees=10).transform(df.where("id % 3 = 0"))
    r = out.agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)), F.var_pop("label")).first()
    assert r[0] < 0.05 * r[1]
    flat = M.reg_forest(df.withColumn("label", F.lit(4.0)), n_trees=2).transform(df.limit(5))
    assert [r["prediction"] for r in flat.collect()] == pytest.approx([4.0] * 5)


def test_blocks_cross_arrow_batches(spark):
    df = _table(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        packed = H._pack(df.select(F.array("c0", "c1", "c2", "c3").alias("x"), F.col("label").cast("double").alias("y")),
                         [np.array([0.5])] * 4, 0.0, 1.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(packed) == 3 and len({r["no"] for r in packed}) == 3
    assert sum(len(r["x"]) for r in packed) == 4 * 3000


def test_importance_does_not_redo_what_led_to_the_rows(spark):
    df = _table(spark, 400)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = df.drop("features").mapInArrow(seen, df.drop("features").schema)
    cols = ["c0", "c1", "c2", "c3"]
    out = M.permutation_importance(M.clf_forest(df, n_trees=5), rows, "id", cols).collect()
    assert read.value == 400
    found = {r["feature"]: r["importance"] for r in out}
    assert max(found, key=found.get) == "c0" and found["c3"] < 0.05
