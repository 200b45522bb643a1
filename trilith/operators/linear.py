"""Ridge and lasso from moments: one scan, then small linear algebra.

A scan sums, per fold, the products of (1, features, label): (p + 2) squared
numbers a fold.  Every penalty and every split into training and held-out
folds is solved from these sums, and so are the held-out errors.  Values are
taken relative to one row, so that large offsets do not cost digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LinearModel:
    """Coefficients and intercept; ``transform`` adds ``prediction``."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.coefficients, self.intercept = Vectors.dense(weights), float(intercept)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        products = F.zip_with(vector_to_array(F.col(features)), weights, lambda a, b: a * b)
        return df.withColumn("prediction", F.aggregate(products, F.lit(self.intercept), lambda acc, v: acc + v))


class Moments:
    """Sums of products of (1, x - offset, y - offset) over some rows."""

    def __init__(self, table: np.ndarray, offset: np.ndarray):
        self.table, self.offset = table, offset

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.table + other.table, self.offset)

    def centred(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
        """(rows, means, covariance sums of x, of x with y, of y)."""
        n = self.table[0, 0]
        mean = self.table[0, 1:] / n
        c = self.table[1:, 1:] - n * np.outer(mean, mean)
        return n, mean, c[:-1, :-1], c[:-1, -1], float(c[-1, -1])

    def model(self, weights: np.ndarray) -> LinearModel:
        _, mean, *_ = self.centred()
        mean = mean + self.offset
        return LinearModel(weights, mean[-1] - mean[:-1] @ weights)

    def r2(self, model: LinearModel) -> float:
        """R2 of a model on these rows."""
        w = model.coefficients.toArray()
        shift = model.intercept + self.offset[:-1] @ w - self.offset[-1]
        v = np.concatenate([[-shift], -w, [1.0]])
        *_, total = self.centred()
        return 1.0 - float(v @ self.table @ v) / total


def moments(df: DataFrame, label: str = "label", features: str = "features", fold: str | None = None) -> dict:
    """{fold: Moments}; without ``fold`` all rows are fold None.  Rows with a
    null label or without features are left out."""
    rows = df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                     vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.where("fold IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    one = rows.first()
    if one is None:
        return {}
    offset = np.array([*one["x"], one["y"]])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(folds), -1)
            z = np.column_stack([np.ones(len(folds)), np.column_stack([x, batch.column("y").to_numpy()]) - offset])
            for f in np.unique(folds).tolist():
                own = z[folds == f]
                sums[f] = sums.get(f, 0.0) + own.T @ own
        for f, table in sums.items():
            at = np.arange(table.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(table.size, f, dtype=np.int32)), pa.array(at),
                                              pa.array(table.ravel())], names=["fold", "at", "v"])

    out = rows.mapInArrow(run, "fold int, at int, v double").groupBy("fold", "at").agg(F.sum("v").alias("v")).toArrow()
    folds, at, v = (out.column(c).to_numpy() for c in ("fold", "at", "v"))
    size = len(offset) + 1
    tables = {}
    for f in np.unique(folds).tolist():
        table = np.zeros(size * size)
        table[at[folds == f]] = v[folds == f]
        tables[f if fold else None] = Moments(table.reshape(size, size), offset)
    return tables


def ridge(m: Moments, alpha: float) -> LinearModel:
    """Least squares with ``alpha`` times the squared weights."""
    _, _, xx, xy, _ = m.centred()
    return m.model(np.linalg.lstsq(xx + alpha * np.eye(len(xy)), xy, rcond=None)[0])


def lasso(m: Moments, alpha: float, max_iter: int = 10_000, tol: float = 1e-10) -> LinearModel:
    """Half the mean squared error with ``alpha`` times the absolute weights,
    by coordinate descent on the covariance."""
    n, _, xx, xy, _ = m.centred()
    w = np.zeros(len(xy))
    for _ in range(max_iter):
        old = w.copy()
        for j in range(len(w)):
            if xx[j, j] > 0:
                rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - n * alpha, 0.0) / xx[j, j]
        if np.abs(w - old).max(initial=0.0) <= tol * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return m.model(w)
