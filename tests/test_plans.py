"""Plan-level checks of the scale rules: no Cartesian products or
nested-loop joins, no whole-group percentile gathers, bounded top-k."""

import pytest

import __spark_entry__ as entry

from .conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


CHECKED = ["category_source_summary", "describe_numeric", "boxplot_by", "correlation_matrix", "impute_median",
           "cap_outliers_iqr", "stratified_split", "kfold_assign", "split_join", "alignment_check", "normalize_text",
           "vocabulary", "bow", "tfidf", "mean_pool", "confusion_matrix", "classification_report", "f1_macro",
           "inertia", "davies_bouldin", "adjusted_rand", "adjusted_mutual_info", "crosstab", "cluster_purity",
           "histogram", "residuals", "score_delta", "leaderboard", "validate_requests", "ranked_probabilities",
           "impute_knn", "expect_domain", "text_udf", "group_apply"]


@pytest.mark.parametrize("key", CHECKED)
def test_no_cartesian_or_nested_loop_joins(spark, key):
    plan = _plan(entry.queries()[key](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_quantiles_do_not_use_percentile_gather(spark):
    for key in ("describe_numeric", "impute_median", "boxplot_by", "iqr_bounds"):
        plan = _plan(entry.queries()[key](spark, SMALL))
        assert "percentile(" not in plan.lower()


def test_stratified_split_has_no_window(spark):
    plan = _plan(entry.queries()["stratified_split"](spark, SMALL))
    assert "Window" not in plan


def test_knn_top_k_is_a_window_group_limit(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("d"))
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy("d"))).where("_r <= 5")
    plan = _plan(top)
    assert "WindowGroupLimit" in plan
