"""Registered queries: imputation and outliers (§2.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import impute as I
from ..sources.items import ITEM_COLUMNS
from .common import CAP_COLUMNS, capped_items, imputed_items, items_sql, union_sql
from .registry import register


@register("impute_median", items_sql(f"SELECT {', '.join(ITEM_COLUMNS)} FROM imp"))
def q_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputed_items(spark, sf_dir)


_QB = {"poids": ("p1", "p3"), "volume": ("v1", "v3"), "prix_revente": ("x1", "x3")}


@register("iqr_bounds", items_sql(union_sql([
    f"SELECT '{c}' AS column_name, round({a}, 6) AS q1, round({b}, 6) AS q3, "
    f"round({a} - 3.0 * ({b} - {a}), 6) AS lower, round({b} + 3.0 * ({b} - {a}), 6) AS upper, "
    f"(SELECT CAST(count_if({c} < {a} - 3.0 * ({b} - {a}) OR {c} > {b} + 3.0 * ({b} - {a})) AS BIGINT) FROM imp) AS n_outside "
    f"FROM qb" for c, (a, b) in _QB.items()])))
def q_iqr_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.iqr_bounds(imputed_items(spark, sf_dir), CAP_COLUMNS, factor=3.0)


@register("cap_outliers_iqr", items_sql(f"SELECT {', '.join(ITEM_COLUMNS)} FROM capped"))
def q_cap_outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped_items(spark, sf_dir)
