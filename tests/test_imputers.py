"""Disk of the iterative imputer and the comparison of imputers."""

import os
import urllib.parse

from pyspark.sql import functions as F

from trilith.operators import impute as I
from trilith.plans.q_composite import compare_imputers
from trilith.session import ensure_checkpoint_dir


def _kept(spark):
    base = urllib.parse.urlparse(ensure_checkpoint_dir(spark)).path
    tables = os.path.join(base, "tables")
    own = [f"{base}/{x}" for x in os.listdir(base) if x.startswith("rdd-")]
    return set(own + [f"{tables}/{x}" for x in (os.listdir(tables) if os.path.isdir(tables) else [])])


def _holes(spark, n=600):
    df = spark.range(n).select(F.col("id").alias("item_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    df = df.withColumn("c", F.col("a") * 3 - F.col("b") + F.rand(3) * 0.01)
    return df.select("item_id", *[F.when((F.col("item_id") + 3 * i) % 7 != 0, F.col(c)).alias(c)
                                  for i, c in enumerate("abc")])


def test_iterative_rounds_replace_each_other_on_disk(spark):
    df = _holes(spark)
    before = _kept(spark)
    out = I.impute_iterative(df, ["a", "b", "c"], max_iter=6, tol=0.0)
    assert len(_kept(spark) - before) == 2
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == 600
    assert all(abs(r["c"] - (3 * r["a"] - r["b"])) < 0.6 for r in rows if r["item_id"] % 7 not in (0, 4))


def test_comparison_counts_every_labelled_row(spark):
    from trilith.sources.items import NUMERIC_COLUMNS
    df = _holes(spark).withColumn("categorie", F.when(F.coalesce("c", F.lit(1.0)) > 1, "x").otherwise("y"))
    df = df.select("item_id", "categorie", *[F.col("abc"[i % 3]).alias(c) for i, c in enumerate(NUMERIC_COLUMNS)])
    out = compare_imputers(df, "categorie", strategies=("median", "iterative"), k=3, n_trees=5).collect()
    assert {r["strategy"] for r in out} == {"median", "iterative"}
    assert all(0.8 < r["accuracy_mean"] <= 1 and 0 <= r["accuracy_std"] < 0.1 for r in out)


def test_comparison_leaves_no_folds_or_forest_rows(spark):
    from trilith.sources.items import NUMERIC_COLUMNS
    df = _holes(spark).withColumn("categorie", F.when(F.col("item_id") % 2 == 0, "x").otherwise("y"))
    df = df.select("item_id", "categorie", *[F.col("abc"[i % 3]).alias(c) for i, c in enumerate(NUMERIC_COLUMNS)])
    base = ensure_checkpoint_dir(spark).removeprefix("file:") + "/tables"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    compare_imputers(df, "categorie", strategies=("median",), k=2, n_trees=2).collect()
    assert not [n for n in set(os.listdir(base)) - before if n.startswith(("imputed", "folds", "compare", "forest"))]
