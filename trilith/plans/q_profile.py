"""Registered queries: profiling and exploratory aggregates (§2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.stats import sql_exact_mean, sql_fround, sql_guarded_corr
from ..operators import profile as P
from ..sources.items import ITEM_COLUMNS, NUMERIC_COLUMNS, item_view
from ..sources.tables import read_table
from ..session import stored
from .common import clean_items, clean_view, items_sql, union_sql
from .registry import register

NUM = NUMERIC_COLUMNS


@register("profile_shape", items_sql(
    "SELECT count(*) AS n_rows, 9 AS n_cols, 7 AS n_numeric, 2 AS n_string FROM items"))
def q_profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_shape(item_view(spark, sf_dir))


@register("null_counts", items_sql(union_sql(
    [f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null FROM items" for c in ITEM_COLUMNS]
    + ["SELECT '__total__' AS column_name, CAST("
       + " + ".join(f"count_if({c} IS NULL)" for c in ITEM_COLUMNS) + " AS BIGINT) AS n_null FROM items"])))
def q_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.null_counts(item_view(spark, sf_dir), ITEM_COLUMNS)


def _describe_sql(src: str, exprs: dict[str, str]) -> str:
    parts = []
    for name, e in exprs.items():
        parts.append(
            f"SELECT '{name}' AS column_name, count({e}) AS count, {sql_fround(sql_exact_mean(e), 6)} AS mean, "
            f"round(stddev_samp({e}), 6) AS std, round(min({e}), 6) AS min, "
            f"round(quantile_cont({e}, 0.25), 6) AS p25, round(quantile_cont({e}, 0.5), 6) AS p50, "
            f"round(quantile_cont({e}, 0.75), 6) AS p75, round(max({e}), 6) AS max FROM {src}")
    return union_sql(parts)


@register("describe_numeric", items_sql(_describe_sql("clean", {c: c for c in NUM})))
def q_describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.describe_numeric(clean_items(spark, sf_dir), NUM)


@register("text_length_stats", _describe_sql("documents", {"text_len": "CAST(length(text) AS DOUBLE)"}))
def q_text_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.text_length_stats(read_table(spark, sf_dir, "documents"), "text")


@register("value_counts", items_sql(
    "SELECT coalesce(categorie, 'Non labellisé') AS value, count(*) AS count FROM items GROUP BY 1"))
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(item_view(spark, sf_dir), "categorie")


@register("value_shares", items_sql("""
SELECT source, categorie, round(n / sum(n) OVER (PARTITION BY source), 3) AS share
FROM (SELECT source, categorie, count(*) AS n FROM items WHERE categorie IS NOT NULL GROUP BY 1, 2)"""))
def q_value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_shares(item_view(spark, sf_dir), "categorie", by="source")


@register("histogram", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS count
      FROM events, b WHERE value IS NOT NULL GROUP BY 1)
SELECT CAST(s.bin AS INTEGER) AS bin,
       round(lo + s.bin * ((hi - lo) / 50), 6) AS bin_lo,
       round(lo + (s.bin + 1) * ((hi - lo) / 50), 6) AS bin_hi,
       coalesce(c.count, 0) AS count
FROM range(50) s(bin) CROSS JOIN b LEFT JOIN c ON c.bin = s.bin""")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    h = P.histogram(read_table(spark, sf_dir, "events"), "value", bins=50)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "count")


@register("histogram_by", items_sql("""
SELECT categorie, CAST(least(floor((poids - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS count
FROM clean, b WHERE poids IS NOT NULL AND categorie IS NOT NULL GROUP BY 1, 2""",
    """,
b AS (SELECT min(poids) AS lo, max(poids) AS hi FROM clean WHERE poids IS NOT NULL AND categorie IS NOT NULL)"""))
def q_histogram_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = stored(clean_view(spark, sf_dir).select("poids", "categorie"), "histogram-by")  # range, then counts
    return P.histogram_by(two, "poids", "categorie", bins=40)


@register("boxplot_by", items_sql("""
SELECT c.categorie, count(*) AS n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(q3 - q1, 6) AS iqr,
       round(min(CASE WHEN poids >= q1 - 1.5 * (q3 - q1) AND poids <= q3 + 1.5 * (q3 - q1) THEN poids END), 6) AS whisker_lo,
       round(max(CASE WHEN poids >= q1 - 1.5 * (q3 - q1) AND poids <= q3 + 1.5 * (q3 - q1) THEN poids END), 6) AS whisker_hi,
       CAST(count_if(poids < q1 - 1.5 * (q3 - q1) OR poids > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM clean c
JOIN (SELECT categorie, quantile_cont(poids, 0.25) AS q1, quantile_cont(poids, 0.5) AS med,
             quantile_cont(poids, 0.75) AS q3
      FROM clean WHERE poids IS NOT NULL AND categorie IS NOT NULL GROUP BY 1) q
  ON q.categorie = c.categorie
WHERE poids IS NOT NULL
GROUP BY c.categorie, q1, med, q3"""))
def q_boxplot_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.boxplot_by(clean_items(spark, sf_dir), "poids", "categorie", factor=1.5)


def _corr_sql(src: str, cols: list[str], indicator: bool = False) -> str:
    parts = []
    for a in cols:
        for b in cols:
            ea = f"CAST({a} IS NULL AS DOUBLE)" if indicator else a
            eb = f"CAST({b} IS NULL AS DOUBLE)" if indicator else b
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({sql_guarded_corr(ea, eb)}, 6) AS corr FROM {src}")
    return union_sql(parts)


@register("correlation_matrix", items_sql(_corr_sql("clean", NUM)))
def q_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.correlation_matrix(clean_view(spark, sf_dir), NUM)


@register("missing_patterns", items_sql(
    "SELECT concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in NUM)
    + ") AS pattern, count(*) AS count FROM clean GROUP BY 1"))
def q_missing_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_patterns(clean_view(spark, sf_dir), NUM)


@register("missing_correlation", items_sql(_corr_sql("clean", NUM, indicator=True)))
def q_missing_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_correlation(clean_view(spark, sf_dir), NUM)


@register("null_rate_by", items_sql(
    "SELECT source, round(avg(CAST(poids IS NULL AS DOUBLE)), 3) AS null_rate "
    "FROM clean WHERE source IS NOT NULL GROUP BY 1"))
def q_null_rate_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.null_rate_by(clean_view(spark, sf_dir), "poids", "source")


@register("little_mcar")
def q_little_mcar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.little_mcar(clean_items(spark, sf_dir), NUM)


@register("dashboard_kpis", items_sql(
    "SELECT count(*) AS n_total, count(categorie) AS n_labelled, CAST(count_if(categorie IS NULL) AS BIGINT) AS n_unlabelled, "
    "count(DISTINCT source) AS n_sources FROM items"))
def q_dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dashboard_kpis(item_view(spark, sf_dir), "categorie", "source")
