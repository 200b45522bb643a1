"""Encoding, scaling and target transforms (§2.5).

Encoders fit a sorted list of distinct values (bounded by the column's
cardinality, checked against ``max_categories``) and apply it as a literal
map lookup, so applying never joins or shuffles.  Scalers fit one row of
moments in one aggregate pass.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import without_nan

MAX_CATEGORIES = 100_000


def fit_categories(df: DataFrame, col: str, max_categories: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-null values (code-point order).

    The distinct values are counted first so that an unexpectedly wide
    column fails instead of flooding the driver.
    """
    vals = df.where(F.col(col).isNotNull()).select(col).distinct()
    n = vals.count()
    if n > max_categories:
        raise ValueError(f"{col!r} has {n} distinct values (> {max_categories}); "
                         "encode it with a join against a written dictionary table")
    return sorted(r[0] for r in vals.collect())


def _lookup(values: list, col: str):
    m = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(values)))
    return F.try_element_at(m, F.col(col)) if values else F.lit(None).cast("int")


def apply_ordinal(df: DataFrame, col: str, values: list, out: str | None = None) -> DataFrame:
    """Code 0..n-1 in fitted order; unknown or NULL -> -1."""
    return df.withColumn(out or f"{col}_enc", F.coalesce(_lookup(values, col), F.lit(-1)).cast("int"))


def ordinal_encode(df: DataFrame, col: str, fit_on: DataFrame | None = None,
                   out: str | None = None) -> DataFrame:
    return apply_ordinal(df, col, fit_categories(fit_on if fit_on is not None else df, col), out)


def apply_label(df: DataFrame, col: str, labels: list, out: str | None = None) -> DataFrame:
    """Label -> index in fitted order; NULL stays NULL."""
    return df.withColumn(out or f"{col}_enc", _lookup(labels, col).cast("int"))


def label_encode(df: DataFrame, col: str, fit_on: DataFrame | None = None,
                 out: str | None = None) -> tuple[DataFrame, list]:
    labels = fit_categories(fit_on if fit_on is not None else df, col)
    return apply_label(df, col, labels, out), labels


def label_decode(df: DataFrame, col: str, labels: list, out: str) -> DataFrame:
    """Index -> label; out-of-range or NULL index -> NULL."""
    arr = F.array(*[F.lit(v) for v in labels])
    return df.withColumn(out, F.try_element_at(arr, (F.col(col) + 1).cast("int")))


def fit_scaler(df: DataFrame, cols: list[str], with_mean: bool = True) -> dict[str, tuple[float, float]]:
    """{col: (mean, population std)}; a zero or undefined std scales by 1;
    NaN counts as NULL."""
    r = without_nan(df, cols).agg(*chain.from_iterable(
        (F.avg(F.col(c).cast("double")).alias(f"{c}__m"),
         F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__s")) for c in cols)).first()
    out = {}
    for c in cols:
        m, s = r[f"{c}__m"], r[f"{c}__s"]
        out[c] = ((m if with_mean else 0.0) or 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    out = without_nan(df, list(params))
    for c, (m, s) in params.items():
        out = out.withColumn(c, (F.col(c) - F.lit(m)) / F.lit(s))
    return out


def inverse_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    out = df
    for c, (m, s) in params.items():
        out = out.withColumn(c, F.col(c) * F.lit(s) + F.lit(m))
    return out


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                   with_mean: bool = True) -> DataFrame:
    return apply_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols, with_mean))


def profile_normalise(df: DataFrame, divisors: dict[str, float]) -> DataFrame:
    out = df
    for c, d in divisors.items():
        out = out.withColumn(c, F.col(c) / F.lit(float(d)))
    return out


def log_target(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_log", F.log1p(F.col(col)))


def exp_target(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_exp", F.expm1(F.col(col)))
