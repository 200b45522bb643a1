"""Tuning against closed forms, NaN as NULL, bounded fetches, few-key joins."""

import math

import numpy as np
from pyspark.sql import functions as F

from trilith.functions import stats
from trilith.functions.stats import exact_quantiles, select_ranks
from trilith.operators import evaluate as E
from trilith.operators import models as M
from trilith.operators.impute import impute_median
from trilith.operators.profile import describe_numeric
from trilith.operators.text import ngrams


def _table(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 5) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "a double, b double, label double, fold int")
    return M.assemble(df, ["a", "b"]), x, y


def _closed(x, y, alpha):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    return np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)


def test_ridge_folds_equal_the_closed_form(spark):
    df, x, y = _table(spark)
    fold = np.arange(60) % 5
    alphas = (0.1, 10.0, 100.0)
    got = {r["alpha"]: r["r2"] for r in M.grid_search_ridge(df, alphas).collect()}
    for a in alphas:
        scores = []
        for k in range(5):
            fx, fy, hx, hy = x[fold != k], y[fold != k], x[fold == k], y[fold == k]
            w = _closed(fx, fy, a)
            model = M.ridge_models(df.where(F.col("fold") != k), [a])[0]()
            assert np.allclose(model.coefficients.toArray(), w, atol=1e-4)
            pred = (hx - fx.mean(axis=0)) @ w + fy.mean()
            scores.append(1 - ((hy - pred) ** 2).sum() / ((hy - hy.mean()) ** 2).sum())
        assert abs(got[a] - np.mean(scores)) < 1e-4


def test_trials_fit_their_own_parameters(spark):
    df, x, _ = _table(spark)
    df = df.withColumn("label", (F.col("a") + F.col("b") > 0).cast("double"))
    for depth, rounds in ((2, 3), (4, 2)):
        model = M.trial_model(df, {"maxDepth": depth, "maxIter": rounds})
        trees = model.models[0].trees
        assert len(trees) == rounds and max(t.depth for t in trees) <= depth
        assert model.models[0].getOrDefault("maxDepth") == depth
    space = {"maxDepth": ("choice", [1, 4]), "maxIter": ("int", 1, 6)}
    res = M.random_search(df, n_trials=3, space=space, num_folds=2, seed=3).collect()
    assert len({r["params"] for r in res}) > 1 and len({round(r["f1_macro"], 6) for r in res}) > 1


def test_macro_f1_takes_labels_of_any_number_type(spark):
    for kind in ("int", "double", "bigint"):
        df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0)], "label int, prediction double")
        got = M.MacroF1Evaluator()._evaluate(df.withColumn("label", F.col("label").cast(kind)))
        assert abs(got - (1 + 2 / 3 + 0) / 3) < 1e-9


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (math.nan,), (None,)], "x double")
    r = describe_numeric(df, ["x"]).first().asDict()
    assert 2 in r.values() and 2.0 in r.values() and not any(isinstance(v, float) and math.isnan(v) for v in r.values())
    assert sorted(v[0] for v in impute_median(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_ranks_of_many_groups_fetch_little(spark, monkeypatch):
    monkeypatch.setattr(stats, "FETCH_ROWS", 50)
    df = spark.range(6000).select((F.col("id") % 40).cast("string").alias("g"),
                                  (F.xxhash64("id") % 1000).cast("double").alias("x"))
    got = exact_quantiles(df, ["x"], [0.25, 0.5], by="g")
    for g, rows in df.toPandas().groupby("g"):
        want = np.quantile(rows["x"], [0.25, 0.5])
        assert np.allclose([got[("x", g)][0.25], got[("x", g)][0.5]], want)


def test_one_value_on_all_rows_is_counted_not_fetched(spark):
    df = spark.range(30_000).select(F.lit(1.0).alias("x"), (F.col("id") % 3).alias("t"))
    got = select_ranks(df, None, F.col("x"), {None: [1, 10_000, 10_001, 30_000]}, tie_cols=[F.col("t")])
    assert [got[(None, r)] for r in (1, 10_000, 10_001, 30_000)] == [(1.0, 0), (1.0, 0), (1.0, 1), (1.0, 2)]


def test_regression_metrics_do_not_join(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], float(v), float(v + e)) for i, (v, e) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    out = E.regression_metrics(df, "y", "p", by=["g"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        y, p = np.array([(a, b) for g, a, b in rows if g == r["g"]]).T
        assert abs(r["r2_log"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-6


def test_column_order(spark):
    d = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, tokens array<string>")
    assert ngrams(d, "doc_id").columns == ["doc_id", "ngram", "n", "count"]
    r = spark.createDataFrame([("m", "t", 0.5), ("k", "t", 0.4)], "model string, task string, f1 double")
    assert E.score_delta(r, "model", "m", "f1", by=["task"]).columns == ["model", "task", "f1", "delta"]


def test_nan_counts_as_null_everywhere(spark):
    from trilith.operators.encode import fit_scaler, standard_scale
    from trilith.operators.knn import impute_knn
    from trilith.operators.profile import correlation_matrix, missing_patterns, null_rate_by
    rows = [(i, float(i), float(2 * i + i % 3), "ab"[i % 2]) for i in range(1, 13)] + [(13, math.nan, 4.0, "a")]
    nulls = [(i, None if math.isnan(x) else x, y, g) for i, x, y, g in rows]
    schema = "id long, x double, y double, g string"
    with_nan, with_null = spark.createDataFrame(rows, schema), spark.createDataFrame(nulls, schema)
    same = [lambda d: correlation_matrix(d, ["x", "y"]), lambda d: missing_patterns(d, ["x", "y"]),
            lambda d: null_rate_by(d, "x", "g"), lambda d: standard_scale(d, ["x"]).orderBy("id"),
            lambda d: impute_knn(d, "id", ["x", "y"], k=3).orderBy("id")]
    for f in same:
        assert f(with_nan).collect() == f(with_null).collect()
    assert fit_scaler(with_nan, ["x"]) == fit_scaler(with_null, ["x"])


def test_boxes_of_few_groups_move_no_rows(spark):
    from trilith.operators.profile import boxplot_by
    df = spark.range(3000).select((F.col("id") % 4).cast("string").alias("g"), (F.col("id") % 97).cast("double").alias("x"))
    plan = boxplot_by(df, "x", "g")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
