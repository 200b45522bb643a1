"""Data-quality expectations (§2.11).

Each expectation returns a small result table (what was expected, what was
found, passed) computed by one aggregate pass, so checks can be logged,
joined and asserted like any other result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expect_row_count(df: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    got = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rows = [("rows", int(n_rows), int(got)), ("columns", int(n_cols), len(df.columns))]
    out = df.sparkSession.createDataFrame(rows, "check string, expected bigint, actual bigint")
    return out.withColumn("passed", F.col("expected") == F.col("actual"))


def expect_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Expected vs actual column name at each position (schema as rows)."""
    n = max(len(cols), len(df.columns))
    rows = [(i + 1, cols[i] if i < len(cols) else None, df.columns[i] if i < len(df.columns) else None)
            for i in range(n)]
    out = df.sparkSession.createDataFrame(rows, "position int, expected string, actual string")
    return out.withColumn("passed", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def expect_domain(df: DataFrame, col: str, values: list) -> DataFrame:
    """Every distinct non-null value against the expected set."""
    seen = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("value")).distinct() \
             .withColumn("in_data", F.lit(True))
    exp = df.sparkSession.createDataFrame([(str(v),) for v in values], "value string").withColumn("in_expected", F.lit(True))
    return (seen.join(exp, "value", "full_outer")
            .select("value", F.coalesce("in_data", F.lit(False)).alias("in_data"),
                    F.coalesce("in_expected", F.lit(False)).alias("in_expected"))
            .withColumn("passed", F.col("in_data") & F.col("in_expected")))


def expect_null_count(df: DataFrame, col: str, lo: int | None = None, hi: int | None = None,
                      max_rate: float | None = None, digits: int = 6) -> DataFrame:
    r = df.agg(F.count_if(F.col(col).isNull()).alias("n_null"),
               F.avg(F.col(col).isNull().cast("double")).alias("null_rate"))
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col("n_null") >= lo)
    if hi is not None:
        ok = ok & (F.col("n_null") <= hi)
    if max_rate is not None:
        ok = ok & (F.col("null_rate") < max_rate)
    return r.select("n_null", F.round("null_rate", digits).alias("null_rate"), ok.alias("passed"))


def expect_non_negative(df: DataFrame, cols: list[str]) -> DataFrame:
    agg = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols])
    st = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr(f"stack({len(cols)}, {st}) AS (column_name, n_negative)") \
              .withColumn("passed", F.col("n_negative") == 0)


def expect_no_nulls(df: DataFrame) -> DataFrame:
    total = None
    for c in df.columns:
        t = F.count_if(F.col(c).isNull())
        total = t if total is None else total + t
    return df.agg(total.alias("n_null")).withColumn("passed", F.col("n_null") == 0)


def expect_split_sizes(df: DataFrame, split: str, expected: dict[str, float], tol: float = 0.02,
                       digits: int = 6) -> DataFrame:
    """Share of each split against its expected share, within ``tol``."""
    counts = df.where(F.col(split).isin(list(expected))).groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    emap = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v)))])
    out = counts.select(split, F.round(share, digits).alias("share"),
                        F.try_element_at(emap, F.col(split)).alias("expected"))
    return out.withColumn("passed", F.abs(F.col("share") - F.col("expected")) <= tol)
