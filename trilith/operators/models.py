"""Model training, tuning and importance on Spark ML (§2.9).

Every estimator works on a ``features`` vector column assembled JVM-side
(``VectorAssembler``) and an integer ``label`` column; fitted models are
``PipelineModel`` objects so that every fitted stage (imputation constants,
scaling, encoders, vectorisers, the estimator) travels together.

Parameter mapping (reference objective -> Spark ML):
* L2 logistic regression with C: ``regParam = 1 / (C * n)``, no
  standardisation (Spark's objective is the mean loss).
* ridge and lasso: solved from moments (see ``linear``), one scan for all
  penalties and folds.
* boosting: softmax over all classes, or squared loss, on histograms of binned
  features (see ``boosting``).
* forests: Spark ML's settings on the same kind of histograms (see ``forest``);
  text vectors go to Spark ML.
* RBF-kernel SVM / SVR: the support vector objectives on Nyström features
  (see ``kernel``), with C, epsilon and gamma as in the reference.
"""

from __future__ import annotations

import functools
import json
import math
import operator
import random

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import boosting, forest, kernel, linear
from .evaluate import f1_macro

SEED = 42


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Features vector; invalid values raise (silently skipping rows would
    drop data)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def _count(df: DataFrame) -> int:
    return df.count()


# ------------------------------------------------------------ classifiers

def clf_majority(train: DataFrame, test: DataFrame, label: str, out: str = "prediction") -> DataFrame:
    """Most frequent training label (ties: smallest label)."""
    top = (train.where(F.col(label).isNotNull()).groupBy(label).count()
           .orderBy(F.desc("count"), F.asc(label)).first())
    return test.withColumn(out, F.lit(top[label] if top else None))


def clf_logreg(train: DataFrame, C: float = 1.0, max_iter: int = 100, label: str = "label"):
    n = _count(train)
    return LogisticRegression(regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
                              family="multinomial", maxIter=max_iter, labelCol=label).fit(train)


def clf_forest(train: DataFrame, n_trees: int = 200, max_depth: int = 10, label: str = "label",
               seed: int = SEED) -> forest.Forest:
    """Forest on few dense features; each node draws the root of their number, rounded up."""
    width = len(train.where(F.col("features").isNotNull()).first()["features"])
    return forest.fit(train, class_count(train, label), n_trees, max_depth, math.ceil(math.sqrt(width)), label, seed=seed)


def clf_forest_wide(train: DataFrame, n_trees: int = 200, max_depth: int = 10, label: str = "label", seed: int = SEED):
    """Forest on text vectors: thousands of features, mostly 0."""
    return RandomForestClassifier(numTrees=n_trees, featureSubsetStrategy="sqrt", maxDepth=max_depth,
                                  seed=seed, labelCol=label).fit(train)


def class_count(train: DataFrame, label: str = "label") -> int:
    """Number of classes of a label that counts from 0."""
    return int(train.agg(F.max(label)).first()[0]) + 1


def clf_boosted(train: DataFrame, rounds: int = 200, depth: int = 6, rate: float = 0.1, subsample: float = 1.0,
                label: str = "label", seed: int = SEED) -> boosting.Boosted:
    """Boosted trees with a tree for each class and round, softmax loss."""
    s = boosting.Settings(rounds=rounds, depth=depth, rate=rate, rows=subsample, seed=seed)
    return boosting.fit(train, s, class_count(train, label), label)


def clf_linear_svc(train: DataFrame, C: float = 1.0, max_iter: int = 100, label: str = "label", parallelism: int = 4):
    n = _count(train)
    svc = LinearSVC(regParam=1.0 / (C * n), maxIter=max_iter, standardization=False)
    return OneVsRest(classifier=svc, labelCol=label, parallelism=parallelism).fit(train)


def clf_naive_bayes(train: DataFrame, alpha: float = 0.1, label: str = "label"):
    """Multinomial NB; features must be non-negative (counts, tf-idf)."""
    return NaiveBayes(modelType="multinomial", smoothing=alpha, labelCol=label).fit(train)


# ------------------------------------------------------------ kernel machines

def rbf_gamma_scale(df: DataFrame, cols: list[str]) -> float:
    """gamma = 1 / (n_features * variance of all feature values)."""
    long = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("v"))
    var = long.agg(F.var_pop("v")).first()[0] or 1.0
    return 1.0 / (len(cols) * var) if var > 0 else 1.0


def clf_rbf_svc(train: DataFrame, cols: list[str], landmarks: int = 128, C: float = 1.0, gamma: float | None = None,
                label: str = "label", seed: int = SEED, folds: int = 5) -> dict:
    """RBF-kernel SVM, each class against the rest, on Nyström features of at
    most ``landmarks`` rows.  Probabilities come from a multinomial logistic
    layer over margins of rows that their machines did not see (``folds``
    folds); all classes and folds are fitted in the same scans."""
    g = gamma if gamma is not None else rbf_gamma_scale(train, cols)
    basis = kernel.Nystrom(kernel.landmarks(train, cols, landmarks, seed), g)
    rows = stored(kernel.training_rows(train, cols, label, folds), "svc-rows")
    classes = sorted(int(r[0]) for r in rows.select("y").distinct().collect())  # one value a class
    problems = [kernel.Problem(c, f) for f in [None, *range(folds)] for c in classes]
    weights = np.array(kernel.minimise(rows, basis, problems, C, 0.0, 1.0)).reshape(folds + 1, len(classes), -1)
    unseen = kernel.with_margins(rows, F.col("x"), basis, weights[1:], "_margins", "fold")
    cal = LogisticRegression(featuresCol="margins", labelCol="y", family="multinomial", regParam=1e-4).fit(
        stored(unseen.select(F.col("_margins"), "y"), "svc-margins").select(array_to_vector("_margins").alias("margins"), "y"))
    return {"basis": basis, "weights": weights[0], "cols": cols, "calibration": cal}


def predict_rbf_svc(model: dict, df: DataFrame) -> DataFrame:
    """Margins of each class, calibrated probabilities and the class of the greatest."""
    m = kernel.with_margins(df, kernel.vector(model["cols"]), model["basis"], model["weights"], "_margins")
    return model["calibration"].transform(m.withColumn("margins", array_to_vector("_margins")).drop("_margins"))


# ------------------------------------------------------------ regressors

def reg_ridge(train: DataFrame, alpha: float = 1.0, label: str = "label"):
    return linear.ridge(linear.moments(train, label)[None], alpha)


def reg_lasso(train: DataFrame, alpha: float = 0.1, label: str = "label"):
    return linear.lasso(linear.moments(train, label)[None], alpha)


def reg_rbf_svr(train: DataFrame, cols: list[str], landmarks: int = 256, C: float = 10.0, epsilon: float = 0.1,
                gamma: float | None = None, label: str = "label", seed: int = SEED) -> dict:
    """RBF-kernel support vector regression (epsilon-insensitive loss) on
    Nyström features of at most ``landmarks`` rows."""
    g = gamma if gamma is not None else rbf_gamma_scale(train, cols)
    basis = kernel.Nystrom(kernel.landmarks(train, cols, landmarks, seed), g)
    rows = stored(kernel.training_rows(train, cols, label), "svr-rows")
    mean, spread = rows.agg(F.avg("y"), F.stddev_pop("y")).first()
    weights = kernel.minimise(rows, basis, [kernel.Problem()], C, epsilon, spread or 1.0, mean)
    return {"basis": basis, "weights": np.array(weights), "cols": cols}


def predict_rbf_svr(model: dict, df: DataFrame) -> DataFrame:
    out = kernel.with_margins(df, kernel.vector(model["cols"]), model["basis"], model["weights"], "_value")
    return out.withColumn("prediction", F.col("_value")[0]).drop("_value")


def reg_boosted(train: DataFrame, rounds: int = 200, depth: int = 4, rate: float = 0.05, label: str = "label",
                seed: int = SEED) -> boosting.Boosted:
    """Boosted trees under squared loss; leaves hold plain means."""
    s = boosting.Settings(rounds=rounds, depth=depth, rate=rate, l2=0.0, seed=seed)
    return boosting.fit(train, s, 0, label, bins=boosting.MAX_BINS)


def reg_forest(train: DataFrame, n_trees: int = 200, max_depth: int = 10, label: str = "label",
               seed: int = SEED) -> forest.Forest:
    return forest.fit(train, 0, n_trees, max_depth, label=label, seed=seed)


# ------------------------------------------------------------ tuning

class MacroF1Evaluator(Evaluator):
    """Macro-averaged F1 (Spark ML's "f1" is the weighted F1)."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        r = f1_macro(dataset.select(F.col(self.label).cast("double").cast("string").alias("y"),
                                    F.col(self.prediction).cast("double").cast("string").alias("p")),
                     "y", "p", digits=12).first()
        return float(r[0]) if r and r[0] is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


def grid_search_ridge(train: DataFrame, alphas=(0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0),
                      fold_col: str = "fold", label: str = "label", num_folds: int = 5) -> DataFrame:
    """k-fold R2 per alpha on precomputed folds; returns (alpha, r2).  One scan
    sums the moments of each fold; every alpha and split is solved from them."""
    parts = linear.moments(train, label, fold=fold_col)
    folds = [parts[k] for k in range(num_folds)]
    totals = [0.0] * len(alphas)
    for k, held in enumerate(folds):
        rest = functools.reduce(operator.add, folds[:k] + folds[k + 1:])
        totals = [t + held.r2(linear.ridge(rest, a)) for t, a in zip(totals, alphas)]
    rows = [(float(a), t / num_folds) for a, t in zip(alphas, totals)]
    return train.sparkSession.createDataFrame(rows, "alpha double, r2 double")


def ridge_models(train: DataFrame, alphas, label: str = "label"):
    """One fit per alpha, each a function without arguments: the closed-form
    ridge with penalty alpha on the rows of ``train``, which are read once."""
    sums = linear.moments(train, label)[None]
    return [functools.partial(linear.ridge, sums, a) for a in alphas]


SEARCH_SPACE = {
    "maxIter": ("int", 100, 500),
    "maxDepth": ("int", 3, 10),
    "stepSize": ("log", 0.01, 0.3),
    "subsamplingRate": ("float", 0.6, 1.0),
    "columnRate": ("float", 0.6, 1.0),
    "l1": ("log", 1e-5, 10.0),
    "l2": ("log", 1e-5, 10.0),
}
TRIAL_SETTINGS = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "rows",
                  "columnRate": "columns", "l1": "l1", "l2": "l2"}


def sample_params(space: dict, n: int, seed: int = SEED) -> list[dict]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for k, spec in space.items():
            kind = spec[0]
            if kind == "int":
                p[k] = rng.randint(spec[1], spec[2])
            elif kind == "float":
                p[k] = rng.uniform(spec[1], spec[2])
            elif kind == "log":
                p[k] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            else:
                p[k] = rng.choice(spec[1])
        out.append(p)
    return out


def trial_model(train: DataFrame, params: dict, label: str = "label", seed: int = SEED, parallelism: int = 4):
    """One-vs-rest boosted trees with a trial's parameters (set on the
    classifier itself: ``OneVsRest.copy`` does not hand them on)."""
    return OneVsRest(classifier=GBTClassifier(seed=seed, **params), labelCol=label, parallelism=parallelism).fit(train)


def trial_settings(params: dict, seed: int = SEED) -> boosting.Settings:
    """A trial's parameters as settings; an unknown name is an error."""
    return boosting.Settings(seed=seed, **{TRIAL_SETTINGS[k]: v for k, v in params.items()})


def random_search(train: DataFrame, n_trials: int = 30, fold_col: str = "fold", label: str = "label",
                  seed: int = SEED, space: dict | None = None, num_folds: int = 5) -> DataFrame:
    """Seeded random search over boosted-tree parameters with k-fold macro-F1.
    Returns one row per trial (params as JSON, mean macro-F1), best first.
    Every (trial, fold) is fitted and scored over all rows, see
    ``boosting.cross_validate``."""
    trials = sample_params(space or SEARCH_SPACE, n_trials, seed)
    scores = boosting.cross_validate(train, [trial_settings(t, seed) for t in trials], num_folds, fold_col, label)
    names = train.sparkSession.createDataFrame([(i, json.dumps(t, sort_keys=True)) for i, t in enumerate(trials)],
                                               "trial int, params string")
    means = scores.groupBy("trial").agg(F.avg("f1_macro").alias("f1_macro"))
    return names.join(means, "trial").select("trial", "params", "f1_macro").orderBy(F.desc("f1_macro"), "trial")


def tuned_boosted(train: DataFrame, search: DataFrame, label: str = "label", seed: int = SEED) -> boosting.Boosted:
    """The first trial of a search (best mean, ties: lowest number), fitted
    over all rows of ``train``."""
    best = json.loads(search.orderBy(F.desc("f1_macro"), "trial").first()["params"])
    return boosting.fit(train, trial_settings(best, seed), class_count(train, label), label)


# ------------------------------------------------------------ importance

def permutation_importance(model, df: DataFrame, id_col: str, cols: list[str], label: str = "label",
                           seed: int = SEED, assemble_cols: list[str] | None = None) -> DataFrame:
    """Drop in macro-F1 when one feature is permuted.

    The permutation pairs the exact rank of each row under one seeded hash
    with the rank of a value under another (ranks by hashed blocks, no
    single-task window), then re-joins by rank; every other column is kept.
    """
    from .split import hashed_rank
    assemble_cols = assemble_cols or cols

    def score(frame: DataFrame) -> float:
        pred = model.transform(assemble(frame, assemble_cols))
        return MacroF1Evaluator(label)._evaluate(pred)

    # what led to the rows is not done again for each feature
    df = stored(df.select(*dict.fromkeys([id_col, label, *cols, *assemble_cols])), "importance-rows")
    base = score(df)
    rows_rank = stored(hashed_rank(df, id_col, None, seed, out="_r1"), "importance-ranks")
    rows = []
    for i, c in enumerate(cols):
        vals = hashed_rank(df.select(id_col, c), id_col, None, seed + 1 + i, out="_r2").select(
            F.col("_r2").alias("_r1"), F.col(c).alias("_perm"))
        perm = rows_rank.join(vals, "_r1").drop(c, "_r1").withColumnRenamed("_perm", c)
        rows.append((c, float(base), float(base - score(perm))))
    return df.sparkSession.createDataFrame(rows, "feature string, base_f1 double, importance double")


def feature_importances(model, cols: list[str]) -> DataFrame | None:
    imp = getattr(model, "featureImportances", None)
    if imp is None:
        return None
    arr = imp.toArray()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(c, float(arr[i])) for i, c in enumerate(cols)], "feature string, importance double")


# ------------------------------------------------------------ scoring helpers

def probability_map(df: DataFrame, labels: list[str], prob: str = "probability", out: str = "proba") -> DataFrame:
    arr = vector_to_array(F.col(prob))
    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(v) for v in labels]), arr))


def ovr_scores(df: DataFrame, raw: str = "rawPrediction", out: str = "probability_arr") -> DataFrame:
    """One-vs-rest output has margins but no probabilities: normalised
    sigmoid of the margins (documented as a normalised score)."""
    arr = vector_to_array(F.col(raw))
    sig = F.transform(arr, lambda m: 1 / (1 + F.exp(-m)))
    tot = F.aggregate(sig, F.lit(0.0), lambda a, v: a + v)
    return df.withColumn(out, F.transform(sig, lambda v: v / tot))


def fit_pipeline(train: DataFrame, stages: list) -> PipelineModel:
    return Pipeline(stages=stages).fit(train)


def confidence(proba: Column) -> Column:
    return F.array_max(F.map_values(proba))
