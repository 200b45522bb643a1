"""Registered queries: model training, tuning, importance (§2.9).

Tabular models learn ``categorie`` of the item view (features: the five
measures scaled on the training split, resale price, encoded source); text
models learn ``documents.lang``; regressors learn log1p(resale price).
Each query returns the predictions (or result table) on held-out rows.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import text as T
from ..operators.encode import apply_label, apply_ordinal, apply_scaler, fit_categories, fit_scaler
from ..operators.split import kfold_assign, stratified_split
from ..sources.items import MEASURE_COLUMNS
from ..sources.tables import read_table
from ..session import materialize, stored
from .common import items_sql, split_cte, split_items
from .registry import register

FEATURES = MEASURE_COLUMNS + ["prix_revente", "source_enc"]


def tabular(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Labelled items with split, encoded source and label, train-fitted
    scaling and a ``features`` vector."""
    s = split_items(spark, sf_dir).where(F.col("categorie").isNotNull())
    train = s.where(F.col("split") == "train")
    s = apply_ordinal(s, "source", fit_categories(train, "source"), "source_enc")
    labels = fit_categories(train, "categorie")
    s = apply_label(s, "categorie", labels, "label")
    s = apply_scaler(s, fit_scaler(s.where(F.col("split") == "train"), MEASURE_COLUMNS))
    s = s.withColumn("source_enc", F.col("source_enc").cast("double"))
    return M.assemble(s, FEATURES), labels


def _parts(df: DataFrame):
    """(train, val, test); the training part is checkpointed once because
    every estimator scans it many times."""
    return (materialize(df.where(F.col("split") == "train")), df.where(F.col("split") == "val"),
            df.where(F.col("split") == "test"))


def _predictions(model, test: DataFrame, id_col: str = "item_id") -> DataFrame:
    return model.transform(test).select(id_col, "label", F.col("prediction").cast("int").alias("prediction"))


@register("clf_majority", items_sql("""
SELECT item_id, categorie, (SELECT categorie FROM splits WHERE split = 'train' GROUP BY 1
                            ORDER BY count(*) DESC, categorie LIMIT 1) AS prediction
FROM splits WHERE split = 'test'""", split_cte("capped")))
def q_clf_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_items(spark, sf_dir)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    return M.clf_majority(train, test.select("item_id", "categorie"), "categorie")


@register("clf_logreg")
def q_clf_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = tabular(spark, sf_dir)
    train, _, test = _parts(df)
    return _predictions(M.clf_logreg(train, C=1.0), test)


@register("clf_forest")
def q_clf_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = tabular(spark, sf_dir)
    train, _, test = _parts(df)
    return _predictions(M.clf_forest(train, n_trees=200), test)


@register("clf_boosted")
def q_clf_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = tabular(spark, sf_dir)
    train, _, test = _parts(df)
    return _predictions(M.clf_boosted(train, rounds=200, depth=6, rate=0.1), test)


@register("clf_rbf_svc")
def q_clf_rbf_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = tabular(spark, sf_dir)
    train, _, test = _parts(df)
    model = M.clf_rbf_svc(train.select("item_id", "label", *FEATURES), FEATURES)
    out = M.predict_rbf_svc(model, test.select("item_id", "label", *FEATURES))
    return out.select("item_id", "label", F.col("prediction").cast("int").alias("prediction"))


@register("clf_linear_svc")
def q_clf_linear_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = tabular(spark, sf_dir)
    train, _, test = _parts(df)
    return _predictions(M.clf_linear_svc(train, C=1.0), test)


# ------------------------------------------------------------ text models

def text_tables(spark: SparkSession, sf_dir: str, ngram=(1, 1), min_df=2, max_df=0.95, max_features=5000,
                stop=None):
    """Documents with split (stratified on lang), label and a count vector
    built JVM-side from the train-fitted vocabulary."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = stratified_split(docs, "doc_id", "lang", seed=42)
    langs = fit_categories(docs.where(F.col("split") == "train"), "lang")
    docs = apply_label(docs, "lang", langs, "label")
    # split and tokens are scanned several times: written once
    toks = stored(T.analyzer_tokens(docs, "text", stop), "text-tokens")
    toks = toks.withColumn("terms", T.ngrams_col(F.col("tokens"), ngram)) if ngram != (1, 1) else \
        toks.withColumn("terms", F.col("tokens"))
    train = toks.where(F.col("split") == "train")
    tf = T.term_counts(train, "doc_id", "tokens", ngram)
    vocab = T.vocabulary(tf, train.count(), min_df, max_df, max_features)
    terms = [r["term"] for r in vocab.orderBy("idx").collect()]  # bounded by max_features
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="features")
    return cv.transform(toks), vocab, terms


@register("clf_naive_bayes")
def q_clf_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _, _ = text_tables(spark, sf_dir)
    train, _, test = _parts(df)
    return _predictions(M.clf_naive_bayes(train, alpha=0.1), test, "doc_id")


# ------------------------------------------------------------ regression

def regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = tabular(spark, sf_dir)
    return df.withColumn("label", F.log1p("prix_revente")).drop("features").transform(
        lambda d: M.assemble(d, MEASURE_COLUMNS + ["source_enc"]))


def _reg_pred(model, test: DataFrame) -> DataFrame:
    return model.transform(test).select("item_id", "label", "prediction")


@register("reg_ridge")
def q_reg_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = _parts(regression_table(spark, sf_dir))
    return _reg_pred(M.reg_ridge(train, alpha=1.0), test)


@register("reg_lasso")
def q_reg_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = _parts(regression_table(spark, sf_dir))
    return _reg_pred(M.reg_lasso(train, alpha=0.1), test)


@register("reg_rbf_svr")
def q_reg_rbf_svr(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = _parts(regression_table(spark, sf_dir))
    cols = MEASURE_COLUMNS + ["source_enc"]
    model = M.reg_rbf_svr(train.select("item_id", "label", *cols), cols, C=10.0, epsilon=0.1)
    return M.predict_rbf_svr(model, test.select("item_id", "label", *cols)).select("item_id", "label", "prediction")


@register("reg_boosted")
def q_reg_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = _parts(regression_table(spark, sf_dir))
    return _reg_pred(M.reg_boosted(train, rounds=200, depth=4, rate=0.05), test)


@register("reg_forest")
def q_reg_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = _parts(regression_table(spark, sf_dir))
    return _reg_pred(M.reg_forest(train, n_trees=200), test)


@register("grid_search_ridge")
def q_grid_search_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, _ = _parts(regression_table(spark, sf_dir))
    folds = materialize(kfold_assign(train, "item_id", None, k=5, seed=42))
    return M.grid_search_ridge(folds, fold_col="fold")


def _search_folds(train: DataFrame) -> DataFrame:
    return materialize(kfold_assign(train, "item_id", "categorie", k=5, seed=42))


@register("random_search")
def q_random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = tabular(spark, sf_dir)
    train, _, _ = _parts(df)
    return M.random_search(_search_folds(train), n_trials=30, num_folds=5)


@register("permutation_importance")
def q_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = tabular(spark, sf_dir)
    train, val, _ = _parts(df)
    model = M.clf_forest(train, n_trees=50)
    return M.permutation_importance(model, val.drop("features"), "item_id", FEATURES, seed=42)


__all__ = ["tabular", "text_tables", "regression_table", "FEATURES"]
