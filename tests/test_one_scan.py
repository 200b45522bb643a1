"""Models whose fits share scans: batched Lloyd, ridge and lasso from moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilith.operators import cluster as K
from trilith.operators import linear, lloyd
from trilith.operators import models as M


def numpy_lloyd(x, centres, max_iter=300, tol=1e-4):
    limit = tol * x.var(axis=0).mean()
    for i in range(1, max_iter + 1):
        near = lloyd.assign(x, centres)
        moved = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        done = ((moved - centres) ** 2).sum() <= limit
        centres = moved
        if done:
            break
    return centres, ((x - centres[lloyd.assign(x, centres)]) ** 2).sum(), i


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.7, (150, 3)) for m in (0, 4, 9, -5)] + [np.full((200, 3), 2.5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    return x, df.repartition(7)


def test_all_starts_move_as_each_alone(points):
    x, df = points
    starts = [lloyd.first_centres(x, k, seed) for k in (2, 3, 5, 9) for seed in range(4)]
    for (centres, cost, rounds), start in zip(lloyd.lloyd(df, "x", starts), starts):
        want, want_cost, want_rounds = numpy_lloyd(x, start)
        assert rounds == want_rounds and cost == pytest.approx(want_cost, rel=1e-9)
        assert np.allclose(centres, want, atol=1e-9)


def test_the_best_start_is_kept(points):
    x, df = points
    seeds = K._seed_rows(df, "x", "id", 1)
    assert len(seeds) == len(x)
    best = lloyd.best_of(df, "x", [2, 4], 5, 1, seeds)
    for k in (2, 4):
        costs = [numpy_lloyd(x, lloyd.first_centres(seeds, k, 1 + i))[1] for i in range(5)]
        assert best[k][1] == pytest.approx(min(costs), rel=1e-9)
    assign, centres, cost = K.kmeans(df, "x", 4, n_init=5, seed=1, id_col="id")
    rows = assign.select("id", "cluster").collect()
    assert len(rows) == len(x) and cost == pytest.approx(best[4][1], rel=1e-12)
    assert all(r["cluster"] == lloyd.assign(x[[r["id"]]], centres)[0] for r in rows)


def test_k_beyond_the_distinct_points_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0]), (4, None)], "id long, x array<double>")
    (centres, cost, _), = lloyd.lloyd(df, "x", [lloyd.first_centres(np.array([[0.0, 1.0], [5.0, 1.0]]), 4, 0)])
    assert cost == 0.0 and len(centres) == 4


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) * [1, 10, 0.1, 1] + [1e4, 0, 5, -3]
    x[:, 3] = 1.0  # a constant column
    y = x[:, :3] @ np.array([1.0, -2.0, 30.0]) + rng.normal(size=400) * 5
    fold = rng.integers(0, 5, 400)
    df = spark.createDataFrame([(float(b), *map(float, a), int(f)) for a, b, f in zip(x, y, fold)],
                               "label double, a double, b double, c double, d double, fold int")
    return x, y, fold, M.assemble(df, ["a", "b", "c", "d"]).repartition(5)


def closed_form(x, y, alpha):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.lstsq(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc, rcond=None)[0]
    return w, y.mean() - x.mean(axis=0) @ w


def test_ridge_and_its_folds_equal_the_closed_form(table):
    x, y, fold, df = table
    for alpha in (0.01, 1.0, 100.0):
        m, (w, b) = M.reg_ridge(df, alpha), closed_form(x, y, alpha)
        assert np.allclose(m.coefficients.toArray(), w, rtol=1e-6, atol=1e-8) and m.intercept == pytest.approx(b, rel=1e-6)
    got = {r["alpha"]: r["r2"] for r in M.grid_search_ridge(df).collect()}
    assert sorted(got) == [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
    for alpha, r2 in got.items():
        want = []
        for k in range(5):
            w, b = closed_form(x[fold != k], y[fold != k], alpha)
            e = y[fold == k] - x[fold == k] @ w - b
            want.append(1 - (e @ e) / ((y[fold == k] - y[fold == k].mean()) ** 2).sum())
        assert r2 == pytest.approx(np.mean(want), abs=1e-8)


def test_lasso_meets_the_optimality_conditions(table):
    x, y, _, df = table
    for alpha in (0.05, 0.5, 2.0):
        m = M.reg_lasso(df, alpha)
        w = m.coefficients.toArray()
        e = y - y.mean() - (x - x.mean(axis=0)) @ w
        slope = (x - x.mean(axis=0)).T @ e / len(y)
        assert np.allclose(slope[w != 0], alpha * np.sign(w[w != 0]), atol=1e-6)
        assert (np.abs(slope[w == 0]) <= alpha + 1e-6).all()
    assert (M.reg_lasso(df, 1e6).coefficients.toArray() == 0).all()


def test_predictions_and_one_job(spark, table):
    x, _, _, df = table
    m = M.reg_ridge(df, 1.0)
    rows = m.transform(df).select("a", "b", "c", "d", "prediction").collect()
    got = np.array([r["prediction"] for r in rows])
    want = np.array([[r[c] for c in "abcd"] for r in rows]) @ m.coefficients.toArray() + m.intercept
    assert np.allclose(got, want)
    sc = spark.sparkContext
    sc.setJobGroup("ridge-grid", "")
    df = df.persist()
    df.count()
    before = len(sc.statusTracker().getJobIdsForGroup("ridge-grid"))
    linear.moments(df, fold="fold")
    after = len(sc.statusTracker().getJobIdsForGroup("ridge-grid"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    df.unpersist()
    assert after - before <= 3  # one row, and the aggregate with its shuffle stage


def test_no_rows(spark):
    df = M.assemble(spark.createDataFrame([(1.0, 2.0)], "label double, a double"), ["a"]).where(F.col("a") > 5)
    assert linear.moments(df) == {}


def test_nearest_centres_of_all_starts_in_one_product():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 4, (500, 3)).astype(float)  # many ties
    sets = [draw.integers(0, 4, (k, 3)).astype(float) for k in (2, 5, 3)]
    sets[1][3] = sets[1][0]
    found = lloyd._sums(x, np.concatenate(sets), [(0, 2), (2, 7), (7, 10)])
    want = []
    for centres in sets:
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        want += [[(near == c).sum(), *x[near == c].sum(axis=0)] for c in range(len(centres))]
    assert np.allclose(found, want)
