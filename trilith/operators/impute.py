"""Imputation and outlier capping (§2.4).

Fit and apply are separate: ``fit_*`` returns small parameters (a dict of
scalars, one entry per column) computed by distributed aggregates; ``apply_*``
is a narrow projection using them as literals, so the fitted parameters of
the training split can be applied to any split, batch or stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles, without_nan


# ---------------------------------------------------------------- median

def fit_median(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact (linear-interpolated) median per column."""
    qs = exact_quantiles(df, cols, [0.5])
    return {c: qs[(c, None)][0.5] for c in cols}


def apply_fill(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    out = without_nan(df, list(values))
    for c, v in values.items():
        if v is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(float(v))))
    return out


def impute_median(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """NULL or NaN -> exact column median (fitted on ``fit_on``, default ``df``)."""
    return apply_fill(df, fit_median(fit_on if fit_on is not None else df, cols))


def fit_mean(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    r = without_nan(df, cols).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: r[c] for c in cols}


# ---------------------------------------------------------------- IQR capping

def fit_iqr_bounds(df: DataFrame, cols: list[str], factor: float = 3.0) -> dict[str, tuple]:
    """{col: (q1, q3, lower, upper)} with lower/upper = Q1 -/+ factor*IQR."""
    qs = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = qs[(c, None)][0.25], qs[(c, None)][0.75]
        if q1 is None:
            out[c] = (None, None, None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1, q3, q1 - factor * iqr, q3 + factor * iqr)
    return out


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = 3.0, digits: int = 6) -> DataFrame:
    """Q1, Q3, the capping bounds and the number of values outside them."""
    b = fit_iqr_bounds(df, cols, factor)
    outside = df.agg(*[
        F.count_if((F.col(c) < F.lit(b[c][2])) | (F.col(c) > F.lit(b[c][3]))).alias(c)
        if b[c][0] is not None else F.lit(0).cast("bigint").alias(c) for c in cols]).first()
    rows = [(c, *[None if v is None else round(v, digits) for v in b[c]], int(outside[c])) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q1 double, q3 double, lower double, upper double, n_outside bigint")


def apply_caps(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Clip to [lower, upper]; NULL stays NULL (``least``/``greatest`` skip
    NULL arguments, so the NULL case is guarded explicitly)."""
    out = df
    for c, (_, _, lo, hi) in bounds.items():
        if lo is None:
            continue
        x = F.col(c)
        out = out.withColumn(c, F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi))))
    return out


def cap_outliers_iqr(df: DataFrame, cols: list[str], factor: float = 3.0,
                     fit_on: DataFrame | None = None) -> DataFrame:
    return apply_caps(df, fit_iqr_bounds(fit_on if fit_on is not None else df, cols, factor))


# ---------------------------------------------------------------- iterative (chained equations)

def _bayesian_ridge(gram: "np.ndarray", xty: "np.ndarray", yty: float, n: int, var_y: float,
                    max_iter: int = 300, tol: float = 1e-3, a1: float = 1e-6, a2: float = 1e-6,
                    l1: float = 1e-6, l2: float = 1e-6) -> "np.ndarray":
    """Bayesian ridge (evidence maximisation) from centred sufficient
    statistics: X'X, X'y, y'y.  Returns the coefficients."""
    import numpy as np
    ev, vecs = np.linalg.eigh(gram)
    ev = np.clip(ev, 0.0, None)
    vh = vecs.T
    alpha = 1.0 / (var_y + np.finfo(np.float64).eps)
    lam = 1.0

    def update(alpha, lam):
        coef = vh.T @ ((vh @ xty) / (ev + lam / alpha))
        rss = yty - 2 * coef @ xty + coef @ gram @ coef
        return coef, max(float(rss), 0.0)

    coef_old = None
    for it in range(max_iter):
        coef, rss = update(alpha, lam)
        gamma = float(np.sum((alpha * ev) / (lam + alpha * ev)))
        lam = (gamma + 2 * l1) / (float(np.sum(coef ** 2)) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rss + 2 * a2)
        if it != 0 and float(np.sum(np.abs(coef_old - coef))) < tol:
            break
        coef_old = coef.copy()
    coef, _ = update(alpha, lam)
    return coef


def impute_iterative(df: DataFrame, cols: list[str], max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """Chained-equation imputation with Bayesian-ridge regressions.

    Start from column means; each round regresses every incomplete column
    (ascending null count) on all the others over the rows where it is
    observed and replaces its missing cells by the prediction.  A round is
    one aggregate pass per column (sums and cross products -> p x p normal
    equations solved on the driver) and one table written to the shared folder,
    where it replaces that of the round before last, so the lineage stays one
    round deep and the folder holds two rounds.  Stops when the largest row-wise sum of
    absolute changes falls below tol x max |observed value|.
    """
    import uuid

    import numpy as np
    from ..session import scratch_path

    spark, name = df.sparkSession, uuid.uuid4().hex

    def written(table: DataFrame, turn: int) -> DataFrame:
        path = scratch_path(spark, f"iterative-{name}-{turn % 2}")
        table.write.mode("overwrite").parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
                   F.max(F.greatest(*[F.abs(F.col(c)) for c in cols])).alias("_maxabs")).first()
    order = sorted([c for c in cols if nulls[c] > 0], key=lambda c: (nulls[c], cols.index(c)))
    if not order:
        return df
    means = fit_mean(df, cols)
    norm_tol = tol * float(nulls["_maxabs"] or 0.0)
    others_keep = [c for c in df.columns if c not in cols]
    X = df.select(*others_keep, *[F.col(c).isNull().alias(f"_m_{c}") for c in cols],
                  *[F.coalesce(F.col(c), F.lit(means[c])).alias(c) for c in cols])
    X = written(X, 0)
    for turn in range(1, max_iter + 1):
        prev = X.select("*", *[F.col(c).alias(f"_p_{c}") for c in order])
        cur = prev
        for c in order:
            feats = [o for o in cols if o != c]
            obs = ~F.col(f"_m_{c}")
            aggs = [F.count(F.lit(1)).alias("n"), F.sum(c).alias("sy"), F.sum(F.col(c) * F.col(c)).alias("syy")]
            aggs += [F.sum(o).alias(f"s_{o}") for o in feats]
            aggs += [F.sum(F.col(o) * F.col(c)).alias(f"sy_{o}") for o in feats]
            aggs += [F.sum(F.col(a) * F.col(b)).alias(f"ss_{a}_{b}") for i, a in enumerate(feats) for b in feats[i:]]
            st = cur.where(obs).agg(*aggs).first()
            n = st["n"]
            if not n:
                continue
            mx = np.array([st[f"s_{o}"] / n for o in feats])
            my = st["sy"] / n
            gram = np.zeros((len(feats), len(feats)))
            for i, a in enumerate(feats):
                for j in range(i, len(feats)):
                    b = feats[j]
                    v = st[f"ss_{a}_{b}"] - n * mx[i] * mx[j]
                    gram[i, j] = gram[j, i] = v
            xty = np.array([st[f"sy_{o}"] - n * mx[i] * my for i, o in enumerate(feats)])
            yty = st["syy"] - n * my * my
            coef = _bayesian_ridge(gram, xty, yty, n, yty / n)
            icpt = my - float(mx @ coef)
            pred = F.lit(float(icpt))
            for o, w in zip(feats, coef):
                pred = pred + F.col(o) * F.lit(float(w))
            cur = cur.withColumn(c, F.when(F.col(f"_m_{c}"), pred).otherwise(F.col(c)))
        change = sum((F.abs(F.col(c) - F.col(f"_p_{c}")) for c in order[1:]),
                     F.abs(F.col(order[0]) - F.col(f"_p_{order[0]}")))
        cur = written(cur.withColumn("_chg", change).drop(*[f"_p_{c}" for c in order]), turn)
        inf_norm = cur.agg(F.max("_chg")).first()[0] or 0.0
        X = cur.drop("_chg")
        if inf_norm < norm_tol:
            break
    return X.drop(*[f"_m_{c}" for c in cols]).select(*df.columns)
