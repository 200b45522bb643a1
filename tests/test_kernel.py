"""Kernel machines, whole-table silhouette and class-size pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilith.operators import cluster as K
from trilith.operators import kernel
from trilith.operators import models as M


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + 0.1 * rng.standard_t(2, 500)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))],
                               "id long, a double, b double, label double")
    return x, y, df.repartition(6)


@pytest.mark.parametrize("C, epsilon", [(10.0, 0.1), (0.05, 0.1), (10.0, 0.5)])
def test_svr_on_all_landmarks_is_the_exact_kernel_machine(curve, C, epsilon):
    """The duality gap bounds the distance to the exact solution."""
    x, y, df = curve
    model = M.reg_rbf_svr(df, ["a", "b"], landmarks=500, C=C, epsilon=epsilon, gamma=0.5)
    out = M.predict_rbf_svr(model, df).orderBy("id").toPandas()
    f, w = out["prediction"].to_numpy(), model["weights"][0]
    gram = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    primal = 0.5 * w[1:] @ w[1:] + C * np.maximum(0, np.abs(y - f) - epsilon).sum()
    h = kernel.WIDTHS[-1] * y.std()
    beta = C * np.clip((np.abs(y - f) - epsilon) / h, 0, 1) * np.sign(y - f)
    assert abs(beta.sum()) < 1e-3 * np.abs(beta).sum()
    dual = beta @ y - epsilon * np.abs(beta).sum() - 0.5 * beta @ gram @ beta
    assert 0 <= primal - dual + 1e-6 <= 0.01 * primal + 0.01
    assert np.abs(f - (gram @ beta + w[0])).max() < 0.05


def test_svr_follows_its_parameters_with_few_landmarks(curve):
    x, y, df = curve
    miss = {}
    for C, epsilon in ((10.0, 0.1), (0.02, 0.1), (10.0, 1.0)):
        model = M.reg_rbf_svr(df, ["a", "b"], landmarks=60, C=C, epsilon=epsilon)
        f = M.predict_rbf_svr(model, df).orderBy("id").toPandas()["prediction"].to_numpy()
        miss[C, epsilon] = np.median(np.abs(y - f))
    assert miss[10.0, 0.1] < 0.15
    assert miss[0.02, 0.1] > 1.3 * miss[10.0, 0.1] and miss[10.0, 1.0] > 1.3 * miss[10.0, 0.1]


def test_svc_separates_rings_and_its_probabilities_are_calibrated(spark):
    rng = np.random.default_rng(5)
    angle, cls = rng.uniform(0, 2 * np.pi, 900), rng.integers(0, 3, 900)
    radius = 1.0 + cls + 0.35 * rng.normal(size=900)
    df = spark.createDataFrame([(i, float(r * np.cos(t)), float(r * np.sin(t)), int(c))
                                for i, (r, t, c) in enumerate(zip(radius, angle, cls))],
                               "id long, a double, b double, label int")
    train, test = df.where("id < 600"), df.where("id >= 600")
    out = M.predict_rbf_svc(M.clf_rbf_svc(train, ["a", "b"], landmarks=80), test).toPandas()
    best = (out["prediction"] == out["label"]).mean()
    nearest = (np.clip(np.round(np.hypot(out["a"], out["b"])) - 1, 0, 2) == out["label"]).mean()
    assert best > nearest - 0.04
    p = np.array([v.toArray() for v in out["probability"]])
    assert np.allclose(p.sum(axis=1), 1) and abs(p.max(axis=1).mean() - best) < 0.08


def test_nulls_have_no_prediction(curve):
    x, y, df = curve
    model = M.reg_rbf_svr(df, ["a", "b"], landmarks=30)
    odd = df.limit(3).withColumn("a", F.when(F.col("id") >= 0, F.lit(None).cast("double")))
    assert [r["prediction"] for r in M.predict_rbf_svr(model, odd).collect()] == [None] * 3


def brute(points, labels):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    out = []
    for i in range(len(points)):
        same = (labels == labels[i]) & (np.arange(len(points)) != i)
        rest = [d[i, labels == c].mean() for c in set(labels) - {labels[i]}]
        a, b = (d[i, same].mean() if same.any() else None), min(rest)
        out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


def test_silhouette_has_a_value_for_every_row(spark, monkeypatch):
    rng = np.random.default_rng(8)
    labels = np.array([0] * 150 + [1] * 80 + [2] * 40 + [3])
    points = rng.normal(size=(271, 3)) + labels[:, None] * 2.0
    points[:5] = points[0]
    rows = [(i, int(c), p.tolist()) for i, (c, p) in enumerate(zip(labels, points))]
    df = spark.createDataFrame(rows + [(900, None, [0.0] * 3), (901, 1, None)], "id long, c int, x array<double>")
    want = brute(points, labels)
    got = K.silhouette_rows(df, "id", "x", "c").orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(271))
    assert np.allclose([r["silhouette"] for r in got], want, atol=1e-6)
    monkeypatch.setattr(K, "REFERENCE_BYTES", 1)  # one cluster at a time
    alone = K.silhouette_rows(df, "id", "x", "c").orderBy("id").collect()
    assert np.allclose([r["silhouette"] for r in alone], want, atol=1e-6)
    some = K.silhouette_rows(df, "id", "x", "c", per_cluster=60).orderBy("id").collect()
    assert len(some) == 271 and abs(np.mean([r["silhouette"] for r in some]) - want.mean()) < 0.05
    assert K.silhouette(df.limit(0), "id", "x", "c").first()[0] is None


def test_ami_of_many_classes(spark):
    """100,000 classes a side have few distinct sizes; a side against itself is 1."""
    df = spark.range(250_000).select((F.col("id") % 100_000).alias("a"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("b"))
    assert abs(K.adjusted_mutual_info(df, "a", "b").first()[0]) < 0.02
    assert K.adjusted_mutual_info(df, "a", "a").first()[0] == 1.0
