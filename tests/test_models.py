"""Property tests for the fitted-model keys (no SQL oracle)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from .conftest import SMALL


def test_batch_scores_are_probabilities(spark):
    from trilith.plans.q_stream import scoring_models
    from trilith.operators.score import batch_score
    from trilith.sources.items import NUMERIC_COLUMNS
    items, clf, reg, labels = scoring_models(spark, SMALL)
    test = items.where(F.col("split") == "test").select("item_id", *NUMERIC_COLUMNS, "source")
    out = batch_score(test, clf, labels, reg)
    rows = out.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, v: a + v).alias("s"),
                      "confidence", "prediction", "price").collect()
    assert rows
    for r in rows:
        assert r["s"] == pytest.approx(1.0, abs=1e-9)
        assert 0.0 < r["confidence"] <= 1.0 and r["prediction"] in labels
        assert r["price"] >= 0.0


def test_saved_model_scores_identically(spark):
    rows = entry.queries()["model_io"](spark, SMALL).collect()
    assert rows and all(r["same"] for r in rows)


def test_stream_equals_batch(spark):
    q = entry.queries()
    s = {r["item_id"]: (r["prediction"], r["confidence"], r["price"]) for r in q["stream_score"](spark, SMALL).collect()}
    from trilith.plans.q_stream import scoring_models
    from trilith.operators.score import batch_score
    from trilith.operators.evaluate import validate_requests
    from trilith.plans.q_eval import REQ
    from trilith.sources.items import NUMERIC_COLUMNS, item_view
    items, clf, reg, labels = scoring_models(spark, SMALL)
    raw = item_view(spark, SMALL).select("item_id", *NUMERIC_COLUMNS, "source")
    req = raw.join(items.where(F.col("split") == "test").select("item_id"), "item_id")
    ok = validate_requests(req, REQ).where("is_valid").drop("is_valid", "reasons")
    b = {r["item_id"]: (r["prediction"], r["confidence"], r["price"]) for r in batch_score(ok, clf, labels, reg).collect()}
    assert s == b and len(s) > 0


def test_ridge_matches_closed_form(spark):
    from trilith.operators.models import assemble, reg_ridge
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(float(y[i]), *map(float, x[i])) for i in range(200)], "label double, a double, b double, c double")
    model = reg_ridge(assemble(df, ["a", "b", "c"]), alpha=1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 1.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-3)


def test_text_model_beats_majority(spark):
    q = entry.queries()
    rows = q["clf_naive_bayes"](spark, "/root/testdata/sf0.01").collect()
    acc = np.mean([r["label"] == r["prediction"] for r in rows])
    maj = max(np.bincount([r["label"] for r in rows])) / len(rows)
    assert acc > maj + 0.2


def test_kmeans_inertia_does_not_rise_with_k(spark):
    from trilith.plans.q_cluster import scaled_items
    from trilith.operators.cluster import kmeans
    df = scaled_items(spark, SMALL)
    costs = [kmeans(df, "x", k, n_init=2, seed=1, max_iter=50)[2] for k in (2, 4, 8)]
    assert costs[0] >= costs[1] * 0.999 >= costs[2] * 0.998


def test_pca_explained_variance_sorted(spark):
    rows = entry.queries()["pca"](spark, SMALL).collect()
    r = {x["component"]: x["explained_variance_ratio"] for x in rows}
    assert 0 < r["pc2"] <= r["pc1"] <= 1


def test_streaming_metrics_equal_batch(spark):
    from trilith.plans.q_stream import _scored_items
    from trilith.sources import io as IO
    from trilith.streaming.scoring import prediction_metrics, stream_prediction_metrics
    scored = _scored_items(spark, SMALL).select("item_id", "prediction", "confidence")
    src = IO.fresh_path(spark, "scored-src")
    scored.repartition(3).write.parquet(src)
    live = stream_prediction_metrics(spark, src, scored.schema, "metrics_test").first()
    batch = prediction_metrics(scored).first()
    assert live["n_predictions"] == batch["n_predictions"]
    assert live["mean_confidence"] == pytest.approx(batch["mean_confidence"], abs=1e-4)


@pytest.mark.parametrize("key", ["category_source_summary", "stratified_split", "kfold_assign", "tfidf",
                                 "boxplot_by", "adjusted_mutual_info"])
def test_results_do_not_depend_on_shuffle_partitions(spark, key):
    fn = entry.queries()[key]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, fn(spark, SMALL).collect()), key=str)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        b = sorted(map(tuple, fn(spark, SMALL).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
