"""Registered queries: expectations, UDF surface (§2.11)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import KEEP_CHARS
from ..functions.text import sql_clean
from ..functions.udf import group_apply, text_udf
from ..operators import quality as Q
from ..sources.items import ITEM_COLUMNS, MEASURE_COLUMNS, item_view
from ..sources.tables import read_table
from .common import capped_items, clean_view, items_sql, split_cte, split_labels, union_sql
from .registry import register

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("expect_row_count", items_sql(
    "SELECT 'rows' AS \"check\", (SELECT count(*) FROM orders) AS expected, count(*) AS actual, "
    "(SELECT count(*) FROM orders) = count(*) AS passed FROM items "
    "UNION ALL SELECT 'columns', 9, 9, TRUE"))
def q_expect_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_orders = read_table(spark, sf_dir, "orders").count()
    return Q.expect_row_count(item_view(spark, sf_dir), n_orders, len(ITEM_COLUMNS))


@register("expect_columns", items_sql(
    "SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name AS expected, column_name AS actual, TRUE AS passed "
    "FROM (DESCRIBE SELECT * FROM items)"))
def q_expect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.expect_columns(item_view(spark, sf_dir), ITEM_COLUMNS)


@register("expect_domain", items_sql(
    "SELECT coalesce(d.value, e.value) AS value, d.value IS NOT NULL AS in_data, e.value IS NOT NULL AS in_expected, "
    "d.value IS NOT NULL AND e.value IS NOT NULL AS passed "
    "FROM (SELECT DISTINCT categorie AS value FROM items WHERE categorie IS NOT NULL) d "
    "FULL OUTER JOIN (SELECT unnest(" + "['" + "', '".join(SEGMENTS) + "']) AS value) e ON e.value = d.value"))
def q_expect_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.expect_domain(item_view(spark, sf_dir), "categorie", SEGMENTS)


@register("expect_null_count", items_sql(
    "SELECT CAST(count_if(categorie IS NULL) AS BIGINT) AS n_null, round(avg(CAST(categorie IS NULL AS DOUBLE)), 6) AS null_rate, "
    "count_if(categorie IS NULL) >= 500 AND count_if(categorie IS NULL) <= 1000 "
    "AND avg(CAST(categorie IS NULL AS DOUBLE)) < 0.2 AS passed FROM items"))
def q_expect_null_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.expect_null_count(item_view(spark, sf_dir), "categorie", 500, 1000, 0.2)


@register("expect_non_negative", items_sql(union_sql(
    [f"SELECT '{c}' AS column_name, CAST(count_if({c} < 0) AS BIGINT) AS n_negative, count_if({c} < 0) = 0 AS passed FROM capped"
     for c in MEASURE_COLUMNS])))
def q_expect_non_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.expect_non_negative(capped_items(spark, sf_dir), MEASURE_COLUMNS)


_NUMS = ["poids", "volume", "conductivite", "opacite", "rigidite", "prix_revente"]


@register("expect_no_nulls", items_sql(
    "SELECT CAST(" + " + ".join(f"count_if({c} IS NULL)" for c in _NUMS) + " AS BIGINT) AS n_null, "
    + " + ".join(f"count_if({c} IS NULL)" for c in _NUMS) + " = 0 AS passed FROM capped"))
def q_expect_no_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.expect_no_nulls(capped_items(spark, sf_dir).select(*_NUMS))


@register("expect_split_sizes", items_sql("""
SELECT split, round(n / sum(n) OVER (), 6) AS share, e AS expected, abs(round(n / sum(n) OVER (), 6) - e) <= 0.02 AS passed
FROM (SELECT split, count(*) AS n, CASE split WHEN 'train' THEN 0.7 WHEN 'val' THEN 0.15 ELSE 0.15 END::DOUBLE AS e
      FROM splits WHERE split IN ('train', 'val', 'test') GROUP BY 1)""", split_cte("capped")))
def q_expect_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.expect_split_sizes(split_labels(spark, sf_dir), "split", {"train": 0.70, "val": 0.15, "test": 0.15})


_WS = "\t\n\x0b\f\r "
_STRIP = re.compile(f"^[{_WS}]+|[{_WS}]+$")
_NONKEEP = re.compile(f"[^{KEEP_CHARS}{_WS}]")
_WSRUN = re.compile(f"[{_WS}]+")


def _py_clean(s: pd.Series) -> pd.Series:
    """Per-row Python cleaner (the reference's row-wise apply), vectorised
    over an Arrow batch."""
    s = s.fillna("").str.lower()
    s = s.str.replace(_STRIP, "", regex=True)
    s = s.str.replace(_NONKEEP, " ", regex=True)
    return s.str.replace(_WSRUN, " ", regex=True)


@register("text_udf", f"SELECT doc_id, {sql_clean('text')} AS text_clean FROM documents")
def q_text_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text_udf(_py_clean, "string")
    return read_table(spark, sf_dir, "documents").select("doc_id", clean(F.col("text")).alias("text_clean"))


def _null_partial(pdf: pd.DataFrame) -> pd.DataFrame:
    g = pdf.assign(_null=pdf["poids"].isna().astype("int64")).groupby("source", dropna=True)
    return g.agg(n_null=("_null", "sum"), n=("_null", "size")).reset_index()


@register("group_apply", items_sql(
    "SELECT source, round(avg(CAST(poids IS NULL AS DOUBLE)), 3) AS null_rate FROM clean WHERE source IS NOT NULL GROUP BY 1"))
def q_group_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean_view(spark, sf_dir).select("source", "poids")
    return group_apply(df, ["source"], _null_partial, "source string, n_null long, n long",
                       merge={"n_null": F.sum("n_null"), "n": F.sum("n")},
                       finish={"null_rate": F.round(F.col("n_null") / F.col("n"), 3)})
