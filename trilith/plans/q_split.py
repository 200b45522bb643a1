"""Registered queries: splits, folds, joins (§2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import split as S
from ..sources.items import NUMERIC_COLUMNS, item_view
from ..sources.tables import read_table
from .common import capped_items, items_sql, split_cte, split_labels
from .registry import register


@register("stratified_split", items_sql("SELECT item_id, categorie, split FROM splits", split_cte("capped")))
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_labels(spark, sf_dir).select("item_id", "categorie", "split")


@register("hash_split", items_sql(
    "SELECT item_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split "
    "FROM (SELECT item_id, CAST(CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR) || '42'), 1, 8)) AS BIGINT) AS DOUBLE)"
    " / CAST(4294967296 AS DOUBLE) AS u FROM items)"))
def q_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_split(item_view(spark, sf_dir).select("item_id"), "item_id", seed=42)


@register("kfold_assign", items_sql("""
SELECT item_id, categorie, CAST((row_number() OVER (PARTITION BY categorie
         ORDER BY md5(CAST(item_id AS VARCHAR) || '42'), item_id) - 1) % 5 AS INTEGER) AS fold
FROM items WHERE categorie IS NOT NULL
UNION ALL SELECT item_id, categorie, CAST(NULL AS INTEGER) AS fold FROM items WHERE categorie IS NULL"""))
def q_kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = item_view(spark, sf_dir).select("item_id", "categorie")
    return S.kfold_assign(df, "item_id", "categorie", k=5, seed=42)


@register("split_join", items_sql(
    "SELECT d.doc_id, d.lang, s.split FROM documents d JOIN splits s ON s.item_id = d.doc_id", split_cte("capped")))
def q_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.split_join(docs, split_labels(spark, sf_dir), "doc_id", "item_id")


@register("combine_modalities", items_sql(
    f"SELECT c.item_id, {', '.join('c.' + x for x in NUMERIC_COLUMNS)}, c.source, d.text "
    "FROM capped c JOIN documents d ON d.doc_id = c.item_id"))
def q_combine_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = capped_items(spark, sf_dir).select("item_id", *NUMERIC_COLUMNS, "source")
    return S.combine_modalities(num, read_table(spark, sf_dir, "documents"), "item_id", "doc_id", ["text"])


@register("alignment_check", """
WITH a AS (SELECT doc_id AS id, count(*) AS na FROM documents GROUP BY 1),
     b AS (SELECT doc_id AS id, count(*) AS nb FROM labels GROUP BY 1),
     j AS (SELECT a.na, b.nb FROM a FULL OUTER JOIN b ON a.id = b.id)
SELECT CAST(coalesce(sum(na), 0) AS BIGINT) AS n_left, CAST(coalesce(sum(nb), 0) AS BIGINT) AS n_right,
       CAST(count_if(na IS NOT NULL AND nb IS NOT NULL) AS BIGINT) AS n_both,
       CAST(count_if(nb IS NULL) AS BIGINT) AS n_left_only, CAST(count_if(na IS NULL) AS BIGINT) AS n_right_only,
       CAST(count_if(na > 1 OR nb > 1) AS BIGINT) AS n_duplicated
FROM j""")
def q_alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.alignment_check(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                             "doc_id", "doc_id")


@register("concat_splits", items_sql(
    "SELECT item_id, categorie, split FROM splits WHERE split <> 'unlabelled'", split_cte("capped")))
def q_concat_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_labels(spark, sf_dir).select("item_id", "categorie", "split")
    parts = [s.where(F.col("split") == name) for name in ("train", "val", "test")]
    return S.concat_splits(*parts)
