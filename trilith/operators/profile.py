"""Profiling and exploratory aggregates (§2.2).

All operators are single-pass aggregates unless stated; wide results are
produced in long form (one row per column or per column pair) with
``stack``, so the output schema does not depend on the input width.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import UNLABELLED
from ..functions.stats import exact_mean, exact_quantiles, guarded_corr, without_nan


def _stack(cols_exprs: list[tuple[str, str]], names: tuple[str, ...]) -> str:
    """``stack`` expression over (label, expr...) tuples."""
    parts = []
    for item in cols_exprs:
        parts.extend(item)
    return f"stack({len(cols_exprs)}, {', '.join(parts)}) AS ({', '.join(names)})"


def _q(c: str) -> str:
    return f"`{c}`"


def profile_shape(df: DataFrame) -> DataFrame:
    """Row count, column count and the number of numeric / string columns."""
    numeric = sum(1 for f in df.schema.fields
                  if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal"))
    strings = sum(1 for f in df.schema.fields if f.dataType.typeName() == "string")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.lit(numeric).alias("n_numeric"), F.lit(strings).alias("n_string"))


def schema_rows(df: DataFrame) -> DataFrame:
    """Column name, position and Spark type as rows (schema as data)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable)
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Nulls per column plus a ``__total__`` row; one pass.  NaN counts as
    missing for floating columns (as in pandas)."""
    cols = cols or df.columns
    types = dict(df.dtypes)

    def missing(c):
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(c)
        return F.count_if(m).alias(c)

    agg = df.agg(*[missing(c) for c in cols])
    total = " + ".join(_q(c) for c in cols)
    return agg.selectExpr(_stack([(f"'{c}'", _q(c)) for c in cols] + [("'__total__'", total)],
                                 ("column_name", "n_null")))


def describe_numeric(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear), max per column.

    Moments come from one aggregate pass (the mean from exact fixed-point
    sums, so it does not depend on the merge order of partial aggregates);
    quartiles from the exact distributed selection (a few more scans, no
    single-task gather).  NaN counts as NULL.
    """
    df = without_nan(df, cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), exact_mean(x, digits).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    moments = df.agg(*aggs).first()
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = []

    def r(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), digits)

    def half_up(v):  # binary half-up, the same operations as the SQL twin
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        p = float(10 ** digits)
        return math.floor(float(v) * p + 0.5) / p

    for c in cols:
        q = qs[(c, None)]
        rows.append((c, int(moments[f"{c}__n"]), half_up(moments[f"{c}__mean"]), r(moments[f"{c}__std"]),
                     r(moments[f"{c}__min"]), r(q[0.25]), r(q[0.5]), r(q[0.75]),
                     r(moments[f"{c}__max"])))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, count bigint, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")


def text_length_stats(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """describe_numeric of the character length of a string column."""
    return describe_numeric(df.select(F.char_length(col).cast("double").alias(f"{col}_len")),
                            [f"{col}_len"], digits)


def value_counts(df: DataFrame, col: str, dropna: bool = False,
                 null_label: str = UNLABELLED) -> DataFrame:
    """Frequency of each value, nulls shown as ``null_label`` unless dropped.

    A hot value is harmless: the count is combined map-side before the
    shuffle, so each task sends one row per distinct value it saw.
    """
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(null_label)).alias("value"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "value"))


def value_shares(df: DataFrame, col: str, by: str | None = None, digits: int = 3) -> DataFrame:
    """Normalised frequencies of ``col`` within each ``by`` group.

    The window runs over the aggregated (group x value) table, not the data.
    """
    keys = [by] if by else []
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.select(*keys, col, F.round(F.col("n") / F.sum("n").over(w), digits).alias("share"))


def _bounds(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    r = df.agg(F.min(F.col(col).cast("double")).alias("lo"),
               F.max(F.col(col).cast("double")).alias("hi")).first()
    return r["lo"], r["hi"]


def _bin_expr(col: str, lo: float, hi: float, bins: int):
    if lo == hi:  # numpy widens a zero-width range to [x-0.5, x+0.5]
        lo, hi = lo - 0.5, hi + 0.5
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    return b, lo, hi


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins over [min, max], the last bin closed.

    Empty bins are kept (0 counts): the bin frame is generated from the
    parameter, not from the data, so it is bounded by ``bins``.
    """
    lo, hi = _bounds(df, col)
    spark = df.sparkSession
    schema = "bin int, bin_lo double, bin_hi double, count bigint"
    if lo is None:
        return spark.createDataFrame([], schema)
    b, lo, hi = _bin_expr(col, lo, hi, bins)
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = F.lit(hi - lo) / F.lit(bins)
    return (frame.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def histogram_by(df: DataFrame, col: str, by: str, bins: int = 40) -> DataFrame:
    """Counts per (group, bin) on edges shared by all groups; non-empty cells."""
    src = df.where(F.col(col).isNotNull() & F.col(by).isNotNull())
    lo, hi = _bounds(src, col)
    if lo is None:
        return df.sparkSession.createDataFrame([], f"{by} string, bin int, count bigint")
    b, _, _ = _bin_expr(col, lo, hi, bins)
    return src.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


BROADCAST_GROUPS = 100_000  # of some 60 bytes each


def boxplot_by(df: DataFrame, col: str, by: str, factor: float = 1.5, digits: int = 6) -> DataFrame:
    """Per group: quartiles, whiskers (furthest datum within factor x IQR of
    the box) and the number of points beyond them.

    Quartiles come from the exact selection; the per-group bounds are a
    table with one row per group, broadcast up to ``BROADCAST_GROUPS`` rows
    (beyond that joined on the group key), so few groups move no data row.
    """
    src = df.where(F.col(col).isNotNull() & F.col(by).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    qs = exact_quantiles(src, [col], [0.25, 0.5, 0.75], by=by)
    rows = [(g, q[0.25], q[0.5], q[0.75]) for (c, g), q in qs.items() if g is not None]
    spark = df.sparkSession
    box = spark.createDataFrame(rows, f"{by} string, q1 double, median double, q3 double")
    box = box.withColumn("iqr", F.col("q3") - F.col("q1")) \
             .withColumn("lo_fence", F.col("q1") - factor * F.col("iqr")) \
             .withColumn("hi_fence", F.col("q3") + factor * F.col("iqr"))
    if len(rows) <= BROADCAST_GROUPS:
        box = F.broadcast(box)
    x = F.col(col).cast("double")
    stats = (src.select(F.col(by).cast("string").alias(by), x.alias("_x"))
             .join(box, by)
             .groupBy(by, "q1", "median", "q3", "iqr")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.min(F.when((F.col("_x") >= F.col("lo_fence")) & (F.col("_x") <= F.col("hi_fence")), F.col("_x"))).alias("whisker_lo"),
                  F.max(F.when((F.col("_x") >= F.col("lo_fence")) & (F.col("_x") <= F.col("hi_fence")), F.col("_x"))).alias("whisker_hi"),
                  F.count_if((F.col("_x") < F.col("lo_fence")) | (F.col("_x") > F.col("hi_fence"))).alias("n_outliers")))
    return stats.select(by, "n", *[F.round(c, digits).alias(c) for c in
                                   ("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi")],
                        "n_outliers")


def correlation_matrix(df: DataFrame, cols: list[str], digits: int = 6,
                       indicator: bool = False) -> DataFrame:
    """Pearson correlation for every ordered pair, pairwise-complete rows,
    one aggregate pass; zero variance gives NULL instead of an ANSI error.
    With ``indicator`` the correlation is taken between null indicators.
    NaN counts as NULL."""
    df = without_nan(df, cols)

    def val(c):
        return F.col(c).isNull().cast("double") if indicator else F.col(c).cast("double")

    aggs = []
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            name = f"c{i}_{j}"
            aggs.append(guarded_corr(val(a), val(b)).alias(name))
            pairs.append((a, b, name))
            if i != j:
                pairs.append((b, a, name))
    one = df.agg(*aggs)
    return one.selectExpr(_stack([(f"'{a}'", f"'{b}'", f"round({n}, {digits})") for a, b, n in pairs],
                                 ("col_a", "col_b", "corr")))


def missing_correlation(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Correlation of the null indicators; a never- or always-null column
    gives NULL."""
    return correlation_matrix(df, cols, digits, indicator=True)


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count of each null bit pattern ('1' = missing; NaN too), columns in order."""
    df = without_nan(df, cols)
    pat = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return df.groupBy(pat.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))


def null_rate_by(df: DataFrame, col: str, by: str, digits: int = 3) -> DataFrame:
    """Share of nulls (NaN too) in ``col`` per ``by`` group (null groups dropped)."""
    return (without_nan(df, [col]).where(F.col(by).isNotNull()).groupBy(by)
            .agg(F.round(F.avg(F.col(col).isNull().cast("double")), digits).alias("null_rate")))


def dashboard_kpis(df: DataFrame, label: str, source: str) -> DataFrame:
    """Total, labelled, unlabelled rows and distinct sources, one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.count(label).alias("n_labelled"),
                  F.count_if(F.col(label).isNull()).alias("n_unlabelled"),
                  F.countDistinct(source).alias("n_sources"))


# ---------------------------------------------------------------- Little's test

def _chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q)."""
    if k <= 0:
        return float("nan")
    a, x = k / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    lg = math.lgamma(a)
    if x < a + 1:  # series for P
        term = total = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - lg))
    b = x + 1 - a  # continued fraction for Q
    c = 1 / 1e-300
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - lg) * h


def little_mcar(df: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """Little's MCAR test.

    Spark computes, in two aggregate passes, the global means, the
    pairwise-complete sample covariances and the per-pattern counts and
    means.  The driver then solves one small (<= p x p) system per missing
    pattern (at most 2^p patterns) -- the only driver-side work.
    """
    p = len(cols)
    x = [F.col(c).cast("double") for c in cols]
    aggs = [F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]
    for i in range(p):
        for j in range(i, p):
            both = x[i].isNotNull() & x[j].isNotNull()
            aggs.append(F.covar_samp(F.when(both, x[i]), F.when(both, x[j])).alias(f"c{i}_{j}"))
    g = df.agg(*aggs).first()
    mean = np.array([g[f"m{i}"] for i in range(p)], dtype=float)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = g[f"c{i}_{j}"] if g[f"c{i}_{j}"] is not None else np.nan
    pattern = F.concat(*[F.when(v.isNull(), F.lit("1")).otherwise(F.lit("0")) for v in x])
    pats = (df.groupBy(pattern.alias("pattern"))
            .agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)])
            .collect())
    d2 = 0.0
    observed_total = 0
    for row in pats:
        obs = [i for i in range(p) if row["pattern"][i] == "0"]
        observed_total += len(obs)
        if not obs:
            continue
        diff = np.array([row[f"m{i}"] - mean[i] for i in obs])
        sub = cov[np.ix_(obs, obs)]
        # pseudo-inverse: a singular sub-covariance (collinear columns) must not abort the test
        d2 += row["n"] * float(diff @ np.linalg.pinv(sub) @ diff)
    dof = observed_total - p
    pval = _chi2_sf(d2, dof) if dof > 0 else float("nan")
    verdict = "MCAR rejected" if pval < alpha else "compatible with MCAR"
    return df.sparkSession.createDataFrame(
        [(float(d2), int(dof), float(pval), verdict, len(pats))],
        "d2 double, dof int, p_value double, verdict string, n_patterns int")
