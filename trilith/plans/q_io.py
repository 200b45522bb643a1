"""Registered queries: sources and sinks (§2.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..sources import io as IO
from ..sources.items import ITEM_COLUMNS, item_view
from .common import items_sql, split_cte, split_labels
from .flagship import FLAGSHIP_SQL, q_flagship
from .registry import register

ORDERS_SCHEMA = StructType([
    StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
    StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
])


@register("scan_items", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_scan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = [f"{sf_dir}/items_raw.csv", f"{sf_dir}/orders.parquet"]  # first existing wins
    return IO.scan_items(spark, candidates, ORDERS_SCHEMA)


@register("ensure_columns", items_sql(
    f"SELECT {', '.join(ITEM_COLUMNS)}, CAST(NULL AS VARCHAR) AS rapport_collecte FROM items"))
def q_ensure_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = StructType([StructField("rapport_collecte", StringType()), StructField("item_id", LongType())])
    return IO.ensure_columns(item_view(spark, sf_dir), want)


@register("write_splits", items_sql("SELECT item_id, categorie, split FROM splits", split_cte("capped")))
def q_write_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_labels(spark, sf_dir).select("item_id", "categorie", "split")
    return IO.write_splits(s, IO.fresh_path(spark, "splits")).select("item_id", "categorie", "split")


@register("write_table", FLAGSHIP_SQL)
def q_write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.write_table(q_flagship(spark, sf_dir), IO.fresh_path(spark, "summary"), fmt="csv")


@register("run_metrics", """
WITH ld AS (SELECT l.*, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
acc AS (SELECT lang, avg(CAST(quality = toxic AS DOUBLE)) AS accuracy,
               avg(CAST(toxic AS DOUBLE)) AS toxic_rate, CAST(count(*) AS DOUBLE) AS n FROM ld GROUP BY 1)
SELECT lang AS run, 'accuracy' AS key, round(accuracy, 6) AS value FROM acc
UNION ALL SELECT lang, 'toxic_rate', round(toxic_rate, 6) FROM acc
UNION ALL SELECT lang, 'n', n FROM acc""")
def q_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .q_eval import labelled_docs
    runs = (labelled_docs(spark, sf_dir).groupBy("lang")
            .agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 6).alias("accuracy"),
                 F.round(F.avg(F.col("toxic").cast("double")), 6).alias("toxic_rate"),
                 F.count(F.lit(1)).cast("double").alias("n")))
    return IO.log_runs(runs, IO.fresh_path(spark, "runs"), "lang", ["accuracy", "toxic_rate", "n"])
