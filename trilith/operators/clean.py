"""Filters, projections and predicates (§2.3).  All are narrow
(map-side) transformations: no shuffle, and filters on raw columns are pushed
into the parquet scan by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_out_of_range(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Set a value to NULL when outside ``lo < x <= hi``; the row is kept.

    ``bounds`` maps column -> (exclusive lower, inclusive upper); either
    side may be None.  NULL stays NULL.
    """
    out = df
    for c, (lo, hi) in bounds.items():
        x = F.col(c)
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (x > F.lit(lo))
        if hi is not None:
            ok = ok & (x <= F.lit(hi))
        out = out.withColumn(c, F.when(ok, x))
    return out


def split_labelled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a label, rows without)."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())


def drop_null_subset(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows that are NULL (or NaN) in any of ``cols``."""
    return df.na.drop(how="any", subset=cols)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text that does not parse as a number becomes NULL (``try_cast``;
    a plain cast raises under ANSI mode)."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    return out


def fill_default(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """NULL -> constant per column."""
    out = df
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def replace_values(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    """Map old values to new ones (a new value may be None); others kept."""
    x = F.col(col)
    expr: Column | None = None
    for old, new in mapping.items():
        cond = x == F.lit(old)
        val = F.lit(new).cast(df.schema[col].dataType)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return df if expr is None else df.withColumn(col, expr.otherwise(x))


def select_features(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """Ordered projection; refuses a feature list that contains the target."""
    if target is not None and target in cols:
        raise ValueError(f"target {target!r} is among the features (leakage)")
    return df.select(*cols)


def serving_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Constants for features a request lacks: an absent column is added,
    a NULL value is replaced."""
    out = df
    for c, v in defaults.items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
        else:
            out = out.withColumn(c, F.lit(v))
    return out
