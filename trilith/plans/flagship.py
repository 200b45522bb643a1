"""Flagship query: clean -> impute -> cap -> per (category, source) summary.

Crosses the scan, a projection filter, two fit/apply steps with exact
quantiles and a final aggregate; each fit is a distributed aggregate whose
result (a handful of scalars) is applied as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import UNLABELLED
from ..functions.stats import exact_mean, fround, sql_exact_mean, sql_fround
from .common import capped_items, items_sql
from .registry import register


def category_source_summary(df: DataFrame, digits: int = 6) -> DataFrame:
    g = (df.groupBy(F.coalesce("categorie", F.lit(UNLABELLED)).alias("categorie"), "source")
         .agg(F.count(F.lit(1)).alias("n_items"),
              fround(exact_mean(F.col("poids")), digits).alias("mean_poids"),
              fround(exact_mean(F.col("prix_revente")), digits).alias("mean_prix")))
    w = Window.partitionBy("source")
    return g.withColumn("share", fround(F.col("n_items") / F.sum("n_items").over(w), digits))


FLAGSHIP_SQL = items_sql(f"""
SELECT coalesce(categorie, 'Non labellisé') AS categorie, source,
       count(*) AS n_items,
       {sql_fround(sql_exact_mean('poids'), 6)} AS mean_poids,
       {sql_fround(sql_exact_mean('prix_revente'), 6)} AS mean_prix,
       {sql_fround('count(*) / sum(count(*)) OVER (PARTITION BY source)', 6)} AS share
FROM capped
GROUP BY 1, 2""")


@register("category_source_summary", FLAGSHIP_SQL)
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_source_summary(capped_items(spark, sf_dir))
