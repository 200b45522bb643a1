"""Registered queries: scoring, model persistence and streaming (§2.10,
§2.11).  The scoring pipelines are fitted on the training split of the
item view; requests are the held-out items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import fit_categories, fit_scaler
from ..operators.evaluate import rule_score
from ..operators.impute import fit_iqr_bounds, fit_median
from ..operators.score import batch_score, fit_classifier_pipeline, fit_price_pipeline, preprocessing_stage
from ..session import stored
from ..sources import io as IO
from ..sources.items import MEASURE_COLUMNS, NUMERIC_COLUMNS, item_view
from ..sources.tables import read_table
from ..streaming.scoring import prediction_log, prediction_metrics, stream_score
from ..functions.constants import CATEGORIES
from ..functions.stats import sql_fround
from .common import clean_view, items_sql
from .q_eval import REQ, _argmax_sql, _rule_probs_cte
from .registry import register

REQUEST_COLS = MEASURE_COLUMNS + ["source"]


def scoring_models(spark: SparkSession, sf_dir: str):
    """(labelled items with split, classifier pipeline, price pipeline, labels)."""
    from ..operators.encode import apply_label
    from ..operators.split import stratified_split
    # Parquet: the fits read few columns of many scans
    items = stratified_split(stored(clean_view(spark, sf_dir), "items"), "item_id", "categorie", seed=42)
    lab = items.where(F.col("categorie").isNotNull())
    train = stored(lab.where(F.col("split") == "train").drop("split"), "train")
    labels = fit_categories(train, "categorie")
    train = apply_label(train, "categorie", labels, "label")
    fill = fit_median(train, NUMERIC_COLUMNS)
    caps = fit_iqr_bounds(train.na.fill(fill), ["poids", "volume", "prix_revente"], 3.0)
    filled = train.na.fill(fill)
    from ..operators.impute import apply_caps
    scaler = fit_scaler(apply_caps(filled, caps), MEASURE_COLUMNS)
    prep = preprocessing_stage(fill=fill, caps=caps, scaler=scaler,
                               ordinal={"source": fit_categories(train, "source")})
    clf = fit_classifier_pipeline(train, prep, MEASURE_COLUMNS + ["prix_revente", "source"])
    price_train = train.where(F.col("prix_revente").isNotNull())
    reg = fit_price_pipeline(price_train, prep, MEASURE_COLUMNS + ["source"], "prix_revente")
    return items, clf, reg, labels


@register("batch_score")
def q_batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, clf, reg, labels = scoring_models(spark, sf_dir)
    test = items.where(F.col("split") == "test").select("item_id", *NUMERIC_COLUMNS, "source")
    return batch_score(test, clf, labels, reg).select("item_id", "prediction", "confidence", "price")


@register("model_io")
def q_model_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save and reload both pipelines; the reloaded models must score the
    held-out rows identically (``same`` is true on every row)."""
    items, clf, reg, labels = scoring_models(spark, sf_dir)
    base = IO.fresh_path(spark, "models")
    IO.save_model(clf, f"{base}/clf")
    IO.save_model(reg, f"{base}/reg")
    clf2, reg2 = IO.load_model(f"{base}/clf"), IO.load_model(f"{base}/reg")
    test = items.where(F.col("split") == "test").select("item_id", *NUMERIC_COLUMNS, "source")
    a = batch_score(test, clf, labels, reg).select("item_id", "prediction", "confidence", "price")
    b = batch_score(test, clf2, labels, reg2).select("item_id", F.col("prediction").alias("p2"),
                                                     F.col("confidence").alias("c2"), F.col("price").alias("x2"))
    j = a.join(b, "item_id")
    return j.select("item_id", ((F.col("prediction") == F.col("p2")) & (F.col("confidence") == F.col("c2"))
                                & (F.col("price") == F.col("x2"))).alias("same"))


@register("stream_score")
def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items arrive as request files; the stream output equals
    batch scoring of the valid requests."""
    items, clf, reg, labels = scoring_models(spark, sf_dir)
    raw = item_view(spark, sf_dir).select("item_id", *NUMERIC_COLUMNS, "source")
    test_ids = items.where(F.col("split") == "test").select("item_id")
    requests = raw.join(test_ids, "item_id")
    src = IO.fresh_path(spark, "requests")
    requests.repartition(4).write.parquet(src)
    base = IO.fresh_path(spark, "scored")
    return stream_score(spark, src, requests.schema, clf, labels, reg, f"{base}/out", f"{base}/_ckpt",
                        keep=["item_id"], bounds=REQ).select("item_id", "prediction", "confidence", "price")


def _scored_items(spark, sf_dir) -> DataFrame:
    df = item_view(spark, sf_dir).select("item_id", "conductivite", "opacite", "rigidite", "prix_revente")
    scored = rule_score(df, "conductivite", "opacite", "rigidite")
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderdate")
    return scored.join(orders, "item_id")


@register("prediction_log", items_sql(f"""
SELECT CAST(to_json(struct_pack("timestamp" := strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S'), prediction := prediction,
                           confidence := {sql_fround('confidence', 4)}, price := {sql_fround('prix_revente', 2)})) AS VARCHAR) AS log
FROM (SELECT item_id, prediction, round(CASE prediction {' '.join(f"WHEN '{k}' THEN p{i}" for i, k in enumerate(CATEGORIES))} END, 6) AS confidence
      FROM (SELECT *, {_argmax_sql(4)} AS prediction FROM rp)) s
JOIN items i ON i.item_id = s.item_id JOIN orders o ON o.o_orderkey = s.item_id""", _rule_probs_cte()))
def q_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_log(_scored_items(spark, sf_dir), "o_orderdate", price="prix_revente")


@register("prediction_metrics", items_sql(f"""
SELECT count(*) AS n_predictions, coalesce(round(avg(confidence), 4), 0.0) AS mean_confidence
FROM (SELECT round(CASE prediction {' '.join(f"WHEN '{k}' THEN p{i}" for i, k in enumerate(CATEGORIES))} END, 6) AS confidence
      FROM (SELECT *, {_argmax_sql(4)} AS prediction FROM rp))""", _rule_probs_cte()))
def q_prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_metrics(_scored_items(spark, sf_dir))

