"""Shared inputs of the registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import null_out_of_range
from ..operators.impute import cap_outliers_iqr, impute_median
from ..sources.items import NUMERIC_COLUMNS, item_view, with_items  # noqa: F401

ITEM_BOUNDS = {"poids": (0.0, 500.0), "volume": (0.0, None), "prix_revente": (0.0, 1000.0)}
CAP_COLUMNS = ["poids", "volume", "prix_revente"]


def clean_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item view with physically impossible values set to NULL, for queries
    that read it once."""
    return null_out_of_range(item_view(spark, sf_dir), ITEM_BOUNDS)


def clean_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clean_view`` for fits that scan it several times.

    Written once to the shared folder: medians, IQR bounds and split cut points
    rescan it, and a scan of the written table is far cheaper than re-running
    the line-item aggregate and the four joins each time.  The shuffle files of
    these go with the write.
    """
    from ..session import stored
    return stored(clean_view(spark, sf_dir), "clean-items")


def imputed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_median(clean_items(spark, sf_dir), NUMERIC_COLUMNS)


def capped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-nulled, median-imputed, IQR-capped (factor 3) items."""
    return cap_outliers_iqr(imputed_items(spark, sf_dir), CAP_COLUMNS, factor=3.0)


# CTEs appended after ``items``: clean, med, imp, qb, capped.
CLEAN_SQL = """,
clean AS (
  SELECT item_id,
    CASE WHEN poids > 0 AND poids <= 500 THEN poids END AS poids,
    CASE WHEN volume > 0 THEN volume END AS volume,
    conductivite, opacite, rigidite,
    CASE WHEN prix_revente > 0 AND prix_revente <= 1000 THEN prix_revente END AS prix_revente,
    categorie, source
  FROM items),
med AS (
  SELECT quantile_cont(poids, 0.5) AS mp, quantile_cont(volume, 0.5) AS mv,
         quantile_cont(conductivite, 0.5) AS mc, quantile_cont(opacite, 0.5) AS mo,
         quantile_cont(rigidite, 0.5) AS mr, quantile_cont(prix_revente, 0.5) AS mx
  FROM clean),
imp AS (
  SELECT item_id, coalesce(poids, mp) AS poids, coalesce(volume, mv) AS volume,
         coalesce(conductivite, mc) AS conductivite, coalesce(opacite, mo) AS opacite,
         coalesce(rigidite, mr) AS rigidite, coalesce(prix_revente, mx) AS prix_revente,
         categorie, source
  FROM clean, med),
qb AS (
  SELECT quantile_cont(poids, 0.25) AS p1, quantile_cont(poids, 0.75) AS p3,
         quantile_cont(volume, 0.25) AS v1, quantile_cont(volume, 0.75) AS v3,
         quantile_cont(prix_revente, 0.25) AS x1, quantile_cont(prix_revente, 0.75) AS x3
  FROM imp),
capped AS (
  SELECT item_id,
    least(greatest(poids, p1 - 3.0 * (p3 - p1)), p3 + 3.0 * (p3 - p1)) AS poids,
    least(greatest(volume, v1 - 3.0 * (v3 - v1)), v3 + 3.0 * (v3 - v1)) AS volume,
    conductivite, opacite, rigidite,
    least(greatest(prix_revente, x1 - 3.0 * (x3 - x1)), x3 + 3.0 * (x3 - x1)) AS prix_revente,
    categorie, source
  FROM imp, qb)"""


def items_sql(sql: str, extra: str = "") -> str:
    """Oracle text with items and the cleaning CTEs in scope."""
    return with_items(sql, CLEAN_SQL + extra)


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def split_cte(src: str = "items", id_col: str = "item_id", label: str = "categorie",
              name: str = "splits", seed: int = 42) -> str:
    """CTE twin of ``stratified_split`` (70/15/15, round half up)."""
    return f""",
{name} AS (
  SELECT {id_col}, {label},
    CASE WHEN rn <= (7000 * n + 5000) // 10000 THEN 'train'
         WHEN rn <= (8500 * n + 5000) // 10000 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT {id_col}, {label},
          row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({id_col} AS VARCHAR) || '{seed}'), {id_col}) AS rn,
          count(*) OVER (PARTITION BY {label}) AS n
        FROM {src} WHERE {label} IS NOT NULL)
  UNION ALL
  SELECT {id_col}, {label}, 'unlabelled' AS split FROM {src} WHERE {label} IS NULL)"""


def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, categorie and the stratified ``split``: no measure is read
    beyond what the item view needs for the two columns."""
    from ..operators.split import stratified_split
    return stratified_split(label_items(spark, sf_dir), "item_id", "categorie", seed=42)


def label_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and categorie, written once (the cut points need several scans)."""
    from ..session import stored
    return stored(item_view(spark, sf_dir).select("item_id", "categorie"), "labels")


def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped items with a ``split`` column (stratified on ``categorie``)."""
    from ..operators.split import stratified_split
    return stratified_split(capped_items(spark, sf_dir), "item_id", "categorie", seed=42)
