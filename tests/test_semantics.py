"""Hand-written edge frames for the semantics of SURVEY §2.12."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trilith.functions.stats import exact_quantiles, select_ranks
from trilith.operators import clean as C
from trilith.operators import encode as E
from trilith.operators import evaluate as V
from trilith.operators import impute as I
from trilith.operators import profile as P
from trilith.operators import split as S
from trilith.operators import text as T


def test_exact_quantiles_match_numpy_with_ties_and_nulls(spark):
    rng = random.Random(7)
    vals = [rng.choice([1.0, 2.0, 2.0, 3.5, None, 10.0]) for _ in range(3000)] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])[("x", None)]
    arr = np.array([v for v in vals if v is not None])
    for q in got:
        assert got[q] == pytest.approx(np.percentile(arr, q * 100), rel=1e-12)


def test_exact_quantiles_hot_value_and_single_row(spark):
    df = spark.createDataFrame([(5.0,)] * 50000 + [(1.0,), (9.0,)], "x double")
    got = exact_quantiles(df, ["x"], [0.5, 0.01])[("x", None)]
    assert got[0.5] == 5.0 and got[0.01] == 5.0
    one = spark.createDataFrame([(3.0,)], "x double")
    assert exact_quantiles(one, ["x"], [0.25])[("x", None)][0.25] == 3.0


def test_exact_quantiles_deep_refinement(spark, monkeypatch):
    import trilith.functions.stats as st
    monkeypatch.setattr(st, "FETCH_ROWS", 10)
    monkeypatch.setattr(st, "BUCKETS", 4)
    vals = [float(i) ** 3 for i in range(400)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = st.exact_quantiles(df, ["x"], [0.3, 0.77])[("x", None)]
    for q, v in got.items():
        assert v == pytest.approx(np.percentile(vals, q * 100), rel=1e-12)


def test_select_ranks_with_ties_uses_tie_columns(spark):
    rows = [("a", 1.0, i) for i in range(5)] + [("a", 0.5, 9), ("b", 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    got = select_ranks(df, F.col("g"), F.col("x"), {"a": [1, 2, 4], "b": [1]}, tie_cols=[F.col("i")])
    assert got[("a", 1)] == (0.5, 9) and got[("a", 2)] == (1.0, 0) and got[("a", 4)] == (1.0, 2)
    assert got[("b", 1)] == (2.0, 1)


def test_range_nulling_bounds_are_exclusive_inclusive(spark):
    df = spark.createDataFrame([(0.0,), (500.0,), (500.0001,), (None,), (1.0,)], "p double")
    out = [r[0] for r in C.null_out_of_range(df, {"p": (0.0, 500.0)}).collect()]
    assert out == [None, 500.0, None, None, 1.0]


def test_capping_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(None,), (1000.0,)], "v double")
    out = I.cap_outliers_iqr(df, ["v"], factor=1.5)
    vals = [r[0] for r in out.collect()]
    assert vals[20] is None and vals[21] < 1000.0


def test_histogram_last_bin_closed_and_single_value(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    h = {r["bin"]: r["count"] for r in P.histogram(df, "x", bins=10).collect()}
    assert h[9] == 1 and h[0] == 1 and h[1] == 1 and sum(h.values()) == 3
    one = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    h1 = P.histogram(one, "x", bins=4).collect()
    assert sum(r["count"] for r in h1) == 2


def test_correlation_of_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    rows = {(r["col_a"], r["col_b"]): r["corr"] for r in P.correlation_matrix(df, ["a", "b"]).collect()}
    assert rows[("a", "b")] is None and rows[("b", "b")] == pytest.approx(1.0)


def test_ordinal_unknown_and_null_get_minus_one(spark):
    train = spark.createDataFrame([("x",), ("y",)], "s string")
    df = spark.createDataFrame([("y",), ("z",), (None,)], "s string")
    out = [r["s_enc"] for r in E.ordinal_encode(df, "s", fit_on=train).collect()]
    assert out == [1, -1, -1]
    lab, labels = E.label_encode(df, "s", fit_on=train)
    assert [r["s_enc"] for r in lab.collect()] == [1, None, None]
    back = E.label_decode(lab, "s_enc", labels, "dec").collect()
    assert [r["dec"] for r in back] == ["y", None, None]


def test_scaler_uses_population_std_and_guards_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    params = E.fit_scaler(df, ["a", "b"])
    assert params["a"] == (2.0, 1.0) and params["b"] == (5.0, 1.0)


def _brute_quota(ids, labels, seed=42):
    import hashlib
    df = pd.DataFrame({"id": ids, "lab": labels})
    df["h"] = [hashlib.md5(f"{i}{seed}".encode()).hexdigest() for i in ids]
    out = {}
    for lab, g in df.groupby("lab"):
        g = g.sort_values(["h", "id"])
        n = len(g)
        c1, c2 = (7000 * n + 5000) // 10000, (8500 * n + 5000) // 10000
        for r, i in enumerate(g["id"], start=1):
            out[i] = "train" if r <= c1 else ("val" if r <= c2 else "test")
    return out


def test_stratified_split_is_quota_exact(spark):
    rng = random.Random(3)
    ids = list(range(1, 2500))
    labels = [rng.choice(["a", "b", "b", "c"]) for _ in ids]
    df = spark.createDataFrame(list(zip(ids, labels)), "id long, lab string").repartition(7)
    got = {r["id"]: r["split"] for r in S.stratified_split(df, "id", "lab").collect()}
    assert got == _brute_quota(ids, labels)


def test_kfold_matches_ranked_round_robin_and_is_partition_invariant(spark):
    import hashlib
    ids = list(range(1000))
    labels = ["x" if i % 3 else "y" for i in ids]
    df = spark.createDataFrame(list(zip(ids, labels)), "id long, lab string")
    a = {r["id"]: r["fold"] for r in S.kfold_assign(df.repartition(1), "id", "lab", k=5).collect()}
    b = {r["id"]: r["fold"] for r in S.kfold_assign(df.repartition(16), "id", "lab", k=5).collect()}
    assert a == b
    p = pd.DataFrame({"id": ids, "lab": labels})
    p["h"] = [hashlib.md5(f"{i}42".encode()).hexdigest() for i in ids]
    p = p.sort_values(["lab", "h", "id"])
    p["rank"] = p.groupby("lab").cumcount()
    assert all(a[i] == r % 5 for i, r in zip(p["id"], p["rank"]))


def test_text_cleaning_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("123 !!",), ("L'Été à Paris, 2024 — œuvre",)], "t string")
    out = [r[0] for r in T.clean_text(df, "t", "c").select("c").collect()]
    assert out[0] == "" and out[1] == "" and out[2] == ""
    assert out[4] == "l été à paris œuvre"
    basic = [r[0] for r in T.tokenize_basic(df, "t", "b").select("b").collect()]
    assert basic[4] == "été paris œuvre"


def test_f1_macro_counts_unpredicted_class_as_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "y string, p string")
    f1 = V.f1_macro(df, "y", "p").first()[0]
    assert f1 == pytest.approx(round((2 / 3 + 0 + 1) / 3, 6))


def test_keyword_score_tie_goes_to_first_class(spark):
    df = spark.createDataFrame([("rien",), ("un flacon de papier",)], "t string")
    out = T.keyword_score(df, "t").collect()
    assert out[0]["prediction"] == "Métal"
    assert out[1]["prediction"] == "Papier"


def test_validate_requests_reasons(spark):
    from trilith.functions.constants import REQUEST_BOUNDS
    cols = list(REQUEST_BOUNDS)
    rows = [(10.0, 10.0, 0.5, 0.5, 5.0), (0.0, 10.0, 0.5, 0.5, 5.0), (None, 600.0, 0.5, 0.5, 11.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    out = V.validate_requests(df).collect()
    assert out[0]["is_valid"] and out[0]["reasons"] == ""
    assert out[1]["reasons"] == "Poids out of range"
    assert out[2]["reasons"] == "Poids missing;Volume out of range;Rigidite out of range"


def _brute_knn(rows, k=5):
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], dtype=float)
    ids = [r[0] for r in rows]
    p = x.shape[1]
    out = x.copy()
    means = np.nanmean(x, axis=0)
    for i in range(len(rows)):
        for c in range(p):
            if not np.isnan(x[i, c]):
                continue
            cands = []
            for j in range(len(rows)):
                if np.isnan(x[j, c]):
                    continue
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not both.any():
                    continue
                d2 = p / both.sum() * np.sum((x[i, both] - x[j, both]) ** 2)
                cands.append((d2, ids[j], x[j, c]))
            cands.sort()
            out[i, c] = np.mean([v for _, _, v in cands[:k]]) if cands else means[c]
    return {ids[i]: out[i] for i in range(len(rows))}


def test_knn_imputation_matches_brute_force(spark):
    from trilith.operators.knn import impute_knn
    rng = random.Random(11)
    rows = []
    for i in range(400):
        v = [round(rng.uniform(0, 100), 1), round(rng.gauss(50, 20), 2), float(rng.randint(1, 4))]
        if i % 40 == 0:
            v = [7.0, 7.0, 2.0]  # many identical donors
        for j in range(3):
            if rng.random() < 0.12:
                v[j] = None
        rows.append((i, *v))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in impute_knn(df, "id", ["a", "b", "c"], k=5).collect()}
    want = _brute_knn(rows)
    for i, vals in got.items():
        assert np.allclose(vals, want[i], rtol=1e-9, atol=1e-9), (i, vals, want[i])


def test_ari_and_ami_are_one_on_identical_labels(spark):
    from trilith.operators.cluster import adjusted_mutual_info, adjusted_rand
    df = spark.createDataFrame([(str(i % 3), str(i % 3)) for i in range(60)], "a string, b string")
    assert adjusted_rand(df, "a", "b").first()[0] == 1.0
    assert adjusted_mutual_info(df, "a", "b").first()[0] == pytest.approx(1.0)


def test_ami_matches_direct_formula(spark):
    from trilith.operators.cluster import adjusted_mutual_info
    rng = random.Random(5)
    pairs = [(rng.choice("xyz"), rng.choice("pq")) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = adjusted_mutual_info(df, "a", "b").first()[0]
    a = pd.Series([p[0] for p in pairs]); b = pd.Series([p[1] for p in pairs])
    n = len(pairs)
    ct = pd.crosstab(a, b).to_numpy().astype(float)
    ai, bj = ct.sum(1), ct.sum(0)
    nz = ct > 0
    mi = np.sum(ct[nz] / n * np.log(n * ct[nz] / np.outer(ai, bj)[nz]))
    h = lambda m: -np.sum(m / n * np.log(m / n))
    emi = 0.0
    for x in ai:
        for y in bj:
            for k in range(max(1, int(x + y - n)), int(min(x, y)) + 1):
                lp = (math.lgamma(x + 1) + math.lgamma(y + 1) + math.lgamma(n - x + 1) + math.lgamma(n - y + 1)
                      - math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(x - k + 1) - math.lgamma(y - k + 1)
                      - math.lgamma(n - x - y + k + 1))
                emi += k / n * math.log(n * k / (x * y)) * math.exp(lp)
    want = (mi - emi) / ((h(ai) + h(bj)) / 2 - emi)
    assert got == pytest.approx(round(want, 6), abs=2e-6)


def test_silhouette_in_range_and_matches_numpy(spark):
    from trilith.operators.cluster import silhouette
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(5, 1, (40, 3))])
    lab = [0] * 40 + [1] * 40
    df = spark.createDataFrame([(i, lab[i], pts[i].tolist()) for i in range(80)], "id long, c int, x array<double>")
    got = silhouette(df, "id", "x", "c", sample_size=1000).first()[0]
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    s = []
    for i in range(80):
        same = [j for j in range(80) if lab[j] == lab[i] and j != i]
        other = [j for j in range(80) if lab[j] != lab[i]]
        a, b = d[i, same].mean(), d[i, other].mean()
        s.append((b - a) / max(a, b))
    assert -1 <= got <= 1 and got == pytest.approx(np.mean(s), rel=1e-9)


def test_iterative_imputer_fills_everything_and_keeps_observed(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = rng.gauss(0, 1)
        rows.append((i, a if rng.random() > 0.1 else None, 2 * a + rng.gauss(0, 0.1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    out = I.impute_iterative(df, ["a", "b", "c"]).orderBy("id").collect()
    for r, o in zip(rows, out):
        assert o["a"] is not None
        if r[1] is not None:
            assert o["a"] == r[1]
        else:
            assert abs(o["a"] - r[2] / 2) < 0.5


def test_exact_ranks_do_not_depend_on_block_count(spark):
    from trilith.operators.split import hashed_rank
    df = spark.range(5000).withColumn("lab", (F.col("id") % 3).cast("string"))
    a = {r["id"]: r["_rank"] for r in hashed_rank(df, "id", "lab", blocks=5000).collect()}
    b = {r["id"]: r["_rank"] for r in hashed_rank(df, "id", "lab", blocks=2).collect()}
    assert a == b


def test_grouped_quantiles_with_many_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{int(g)}", float(v)) for g, v in zip(rng.integers(0, 300, 30000), rng.normal(size=30000))]
    df = spark.createDataFrame(rows, "g string, x double")
    import trilith.functions.stats as st
    got = st.exact_quantiles(df, ["x"], [0.25, 0.5], by="g")
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for (c, g), q in got.items():
        vals = pdf.loc[pdf.g == g, "x"].to_numpy()
        for p, v in q.items():
            assert v == pytest.approx(np.percentile(vals, p * 100), rel=1e-12, abs=1e-12)
