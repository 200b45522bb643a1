"""Registered queries composed from several operators (§2.4, §2.9):
iterative imputation, the imputer comparison, the joint numeric + text
model and the vectoriser x classifier grid."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import training_stopwords
from ..operators import models as M
from ..operators import text as T
from ..operators.encode import apply_label, apply_scaler, fit_categories, fit_scaler
from ..operators.evaluate import accuracy, f1_macro
from ..operators.impute import apply_fill, fit_median, impute_iterative
from ..operators.split import kfold_assign, stratified_split
from ..session import dropped, materialize, scratch_path, stored, written
from ..sources.items import NUMERIC_COLUMNS
from ..sources.tables import read_table
from .common import clean_items, items_sql
from .registry import register

_N = NUMERIC_COLUMNS
_SS = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0.0 END"
                 for c in _N)
_CNT = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in _N)
_KNN_SQL = items_sql(
    "SELECT x.item_id, " + ", ".join(
        f"round(coalesce(x.{c}, k{j}.v, (SELECT avg({c}) FROM x)), 6) AS {c}" for j, c in enumerate(_N))
    + " FROM x " + " ".join(f"LEFT JOIN k{j} ON k{j}.rid = x.item_id" for j in range(len(_N))),
    f""",
x AS (SELECT item_id, {', '.join(_N)} FROM clean),
r AS (SELECT * FROM x WHERE {' OR '.join(f'{c} IS NULL' for c in _N)}),
pd AS (SELECT r.item_id AS rid, d.item_id AS did, CAST(6 AS DOUBLE) / ({_CNT}) * ({_SS}) AS dist2,
              {', '.join(f'd.{c} AS d{j}, r.{c} IS NULL AS m{j}' for j, c in enumerate(_N))}
       FROM r JOIN x d ON d.item_id <> r.item_id WHERE ({_CNT}) > 0),
""" + ",\n".join(
        f"k{j} AS (SELECT rid, avg(d{j}) AS v FROM (SELECT rid, d{j}, row_number() OVER (PARTITION BY rid ORDER BY dist2, did) AS rn "
        f"FROM pd WHERE m{j} AND d{j} IS NOT NULL) WHERE rn <= 5 GROUP BY 1)" for j in range(len(_N))))


@register("impute_knn", _KNN_SQL)
def q_impute_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.knn import impute_knn
    df = clean_items(spark, sf_dir).select("item_id", *_N)
    out = impute_knn(df, "item_id", _N, k=5)
    return out.select("item_id", *[F.round(c, 6).alias(c) for c in _N])


@register("impute_iterative")
def q_impute_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean_items(spark, sf_dir).select("item_id", *NUMERIC_COLUMNS)
    return impute_iterative(df, NUMERIC_COLUMNS, max_iter=10, tol=1e-3)


def _impute(df: DataFrame, strategy: str) -> DataFrame:
    if strategy == "median":
        return apply_fill(df, fit_median(df, NUMERIC_COLUMNS))
    if strategy == "iterative":
        return impute_iterative(df, NUMERIC_COLUMNS)
    if strategy == "knn":
        from ..operators.knn import impute_knn
        return impute_knn(df, "item_id", NUMERIC_COLUMNS, k=5)
    raise ValueError(strategy)


def compare_imputers(df: DataFrame, label: str, strategies=("median", "knn", "iterative"), k: int = 5,
                     n_trees: int = 50) -> DataFrame:
    """k-fold accuracy (mean, population std) of a forest on each imputed
    table, best first."""
    spark = df.sparkSession
    rows = []
    labels = fit_categories(df, label)
    for strat in strategies:
        imp = _impute(df, strat)
        imp = apply_label(imp, label, labels, "label")
        path = scratch_path(spark, f"compare-{uuid.uuid4().hex}")
        imp = written(M.assemble(imp, NUMERIC_COLUMNS), f"{path}/imputed")  # ranking scans it several times
        folds = kfold_assign(imp, "item_id", label, k=k, seed=42).select("label", "features", "fold")
        folds = written(folds, f"{path}/folds")
        dropped(spark, f"{path}/imputed")
        scores = []
        for f in range(k):
            train, val = folds.where(F.col("fold") != f), folds.where(F.col("fold") == f)
            model = M.clf_forest(train, n_trees=n_trees, max_depth=5, seed=42)
            pred = model.transform(val)
            scores.append(accuracy(pred, "label", "prediction", digits=12).first()[0])
        mean = sum(scores) / k
        std = (sum((s - mean) ** 2 for s in scores) / k) ** 0.5
        rows.append((strat, float(mean), float(std)))
        dropped(spark, path)
    res = spark.createDataFrame(rows, "strategy string, accuracy_mean double, accuracy_std double")
    return res.orderBy(F.desc("accuracy_mean"), "strategy")


@register("compare_imputers")
def q_compare_imputers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean_items(spark, sf_dir).where(F.col("categorie").isNotNull()).select(
        "item_id", "categorie", *NUMERIC_COLUMNS)
    return compare_imputers(df, "categorie")


# ------------------------------------------------------------ text vectors

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = stratified_split(docs, "doc_id", "lang", seed=42)
    return apply_label(docs, "lang", fit_categories(docs.where(F.col("split") == "train"), "lang"), "label")


def tfidf_vectors(toks: DataFrame, train: DataFrame, ngram=(1, 2), min_df=2, max_df=0.90, max_features=8000,
                  out: str = "features") -> DataFrame:
    """TF-IDF fitted on ``train`` (vocabulary + idf), applied to ``toks``,
    as sparse ML vectors; documents without vocabulary terms get an empty
    vector."""
    tf_train = T.term_counts(train, "doc_id", "tokens", ngram)
    n = train.count()
    vocab = stored(T.vocabulary(tf_train, n, min_df, max_df, max_features), "vocabulary")
    idf = T.fit_idf(vocab, n)
    w = T.tfidf(T.term_counts(toks, "doc_id", "tokens", ngram), idf, "doc_id")
    size = vocab.count()
    vecs = stored(T.to_sparse_vectors(w, "doc_id", "weight", size, out), "vectors")  # read twice below
    missing = toks.select("doc_id").join(vecs.select("doc_id"), "doc_id", "left_anti")
    from pyspark.ml.linalg import SparseVector, VectorUDT
    blank = F.udf(lambda: SparseVector(size, [], []), VectorUDT())()
    return vecs.unionByName(missing.withColumn(out, blank))


def _dense(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(col))


def text_feature_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    docs = _docs(spark, sf_dir)
    toks = materialize(T.analyzer_tokens(docs, "text").select("doc_id", "split", "label", "tokens"))
    train = toks.where(F.col("split") == "train")
    meta = toks.select("doc_id", "split", "label")
    sets = {}
    # bag of words (vocabulary fitted on train)
    tf_train = T.term_counts(train, "doc_id", "tokens", (1, 1))
    vocab = T.vocabulary(tf_train, train.count(), 2, 0.95, 5000)
    terms = [r["term"] for r in vocab.orderBy("idx").collect()]  # bounded by max_features
    from pyspark.ml.feature import CountVectorizerModel
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="features")
    sets["BoW"] = cv.transform(toks).select("doc_id", "split", "label", "features")
    sets["TF-IDF"] = meta.join(tfidf_vectors(toks, train), "doc_id")
    # word vectors: skip-gram on all splits' tokens (as the reference), mean pooled
    wv = T.word2vec(toks, "tokens", dim=100, window=5, min_count=2, epochs=10, seed=42)
    pooled = T.mean_pool(toks, "doc_id", "tokens", wv, 100)
    sets["Word2Vec"] = meta.join(_dense(pooled, "vec"), "doc_id").drop("vec")
    words = toks.select(F.explode("tokens").alias("word")).distinct()
    sub = T.subword_embed(wv, words, 100)
    pooled_sub = T.mean_pool(toks, "doc_id", "tokens", sub, 100)
    sets["FastText"] = meta.join(_dense(pooled_sub, "vec"), "doc_id").drop("vec")
    return toks, sets


CLASSIFIERS = ["MultinomialNB", "LinearSVC", "LogReg", "RandomForest"]


def _fit(name: str, train: DataFrame):
    if name == "MultinomialNB":
        return M.clf_naive_bayes(train, alpha=0.1)
    if name == "LinearSVC":
        return M.clf_linear_svc(train, C=1.0, max_iter=100)
    if name == "LogReg":
        return M.clf_logreg(train, C=1.0, max_iter=100)
    return M.clf_forest_wide(train, n_trees=100, max_depth=10)


def vectorizer_grid(sets: dict[str, DataFrame]) -> DataFrame:
    """Validation macro-F1 and accuracy for every (vectoriser, classifier)
    pair; naive Bayes only on non-negative (sparse count / tf-idf) inputs."""
    rows = []
    spark = None
    for vname, df in sets.items():
        df = materialize(df)
        spark = df.sparkSession
        train, val = df.where(F.col("split") == "train"), df.where(F.col("split") == "val")
        for cname in CLASSIFIERS:
            if cname == "MultinomialNB" and vname not in ("BoW", "TF-IDF"):
                continue
            pred = _fit(cname, train).transform(val).select("label", F.col("prediction").cast("int").alias("p"))
            f1 = f1_macro(pred, "label", "p", digits=6).first()[0]
            acc = accuracy(pred, "label", "p", digits=6).first()[0]
            rows.append((vname, cname, float(f1), float(acc)))
    return spark.createDataFrame(rows, "vectorizer string, classifier string, f1_macro double, accuracy double")


@register("vectorizer_grid")
def q_vectorizer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sets = text_feature_sets(spark, sf_dir)
    return vectorizer_grid(sets)


@register("multimodal_fit")
def q_multimodal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items joined with their document: imputed, std-scaled (no centring)
    measures + TF-IDF (with stop-words) of the text -> one forest; returns
    held-out predictions of the document language."""
    docs = _docs(spark, sf_dir)
    nums = clean_items(spark, sf_dir).select("item_id", *NUMERIC_COLUMNS)
    joined = docs.join(nums.withColumnRenamed("item_id", "doc_id"), "doc_id")
    train = joined.where(F.col("split") == "train")
    joined = apply_fill(joined, fit_median(train, NUMERIC_COLUMNS))
    joined = apply_scaler(joined, fit_scaler(joined.where(F.col("split") == "train"), NUMERIC_COLUMNS, with_mean=False))
    toks = materialize(T.analyzer_tokens(joined, "text", training_stopwords()))
    text_vec = tfidf_vectors(toks, toks.where(F.col("split") == "train"), out="text_vec")
    full = toks.join(text_vec, "doc_id")
    full = M.assemble(full, NUMERIC_COLUMNS + ["text_vec"])
    train = materialize(full.where(F.col("split") == "train").select("doc_id", "label", "features"))
    model = M.clf_forest_wide(train, n_trees=100, max_depth=10)
    test = full.where(F.col("split") == "test")
    return model.transform(test).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))
