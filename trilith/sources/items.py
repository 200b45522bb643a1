"""Item view: the reference-shaped item table derived from the test tables.

The test tables carry no nulls and no out-of-range values, so the view
injects both by fixed rules on the order key (documented in FIXTURES.md).
Every order becomes one item; no row is dropped.

Plan: line items are pre-aggregated per order key (map-side partial
aggregate, one shuffle on the key) before the join with orders, so the join
input is one row per order.  Nation and region are TPC-H dimension tables of
fixed size (25 and 5 rows) and are broadcast; customer is joined by key and
left to AQE (it grows with the scale factor).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

ITEM_COLUMNS = ["item_id", "poids", "volume", "conductivite", "opacite",
                "rigidite", "prix_revente", "categorie", "source"]
NUMERIC_COLUMNS = ["poids", "volume", "conductivite", "opacite", "rigidite",
                   "prix_revente"]
MEASURE_COLUMNS = NUMERIC_COLUMNS[:-1]

# The same view as SQL text; used inside DuckDB oracle queries.
ITEMS_SQL = """
SELECT o.o_orderkey AS item_id,
  CASE WHEN o.o_orderkey % 97 = 0 THEN -1.0 WHEN o.o_orderkey % 101 = 0 THEN 999.0 WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE max(l.l_quantity) * 9.0 END AS poids,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE max(l.l_extendedprice) / 300.0 END AS volume,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE abs(max(l.l_discount)) * 10.0 END AS conductivite,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE abs(max(l.l_tax)) * 12.5 END AS opacite,
  CAST(CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE 1 + count(l.l_orderkey) % 10 END AS DOUBLE) AS rigidite,
  CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE o.o_totalprice / 500.0 END AS prix_revente,
  CASE WHEN o.o_orderkey % 20 = 0 THEN NULL ELSE c.c_mktsegment END AS categorie,
  r.r_name AS source
FROM orders o
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
GROUP BY o.o_orderkey, o.o_totalprice, c.c_mktsegment, r.r_name
"""


def with_items(sql: str, extra: str = "") -> str:
    """Prefix an oracle query with the item view as a CTE."""
    return f"WITH items AS ({ITEMS_SQL}){extra}\n{sql}"


def item_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.max("l_quantity").alias("_q"),
               F.max("l_extendedprice").alias("_p"),
               F.max("l_discount").alias("_d"),
               F.max("l_tax").alias("_t"),
               F.count("l_orderkey").alias("_n")))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select(
        "r_regionkey", "r_name")
    j = (orders
         .join(li, orders.o_orderkey == li.l_orderkey, "left")
         .join(cust, orders.o_custkey == cust.c_custkey, "left")
         .join(F.broadcast(nation), F.col("c_nationkey") == nation.n_nationkey, "left")
         .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey, "left"))
    k = F.col("o_orderkey")

    def unless(mod: int, value):
        return F.when(k % mod == 0, F.lit(None)).otherwise(value)

    return j.select(
        k.alias("item_id"),
        F.when(k % 97 == 0, F.lit(-1.0)).when(k % 101 == 0, F.lit(999.0))
         .when(k % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("_q") * 9.0).alias("poids"),
        unless(17, F.col("_p") / 300.0).cast("double").alias("volume"),
        unless(19, F.abs(F.col("_d")) * 10.0).cast("double").alias("conductivite"),
        unless(23, F.abs(F.col("_t")) * 12.5).cast("double").alias("opacite"),
        unless(29, 1 + F.coalesce(F.col("_n"), F.lit(0)) % 10).cast("double").alias("rigidite"),
        unless(31, F.col("o_totalprice") / 500.0).cast("double").alias("prix_revente"),
        unless(20, F.col("c_mktsegment")).cast("string").alias("categorie"),
        F.col("r_name").alias("source"),
    )
