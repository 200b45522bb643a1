"""RBF kernel machines on Nyström features.

A bounded number of landmark rows gives features whose inner products equal
the kernel on the landmarks and approximate it elsewhere; with all rows as
landmarks the machine is the exact kernel one.  The objectives are those of
support vector machines, 1/2 |w|^2 + C * sum of losses with a free intercept:
max(0, |y - f| - epsilon) for regression, max(0, 1 - y f) for each class
against the rest.

They are minimised by Newton steps.  A step is two scans: one sums gradients
and Hessians per task, one the objective at several step lengths; the driver
gets the sums, whose size depends on the landmarks alone.  All classes and
all cross-validation folds move in the same scans.  The corners of the losses
are rounded over a width that falls from wide, where the fit is least
squares, to ``WIDTHS[-1]`` (relative to the label's spread), which takes at
most half that width off a row's loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS = (10.0, 1.0, 0.1, 0.01)
ROUNDS, TOLERANCE = 30, 1e-6  # Newton steps of a width, least relative progress
LENGTHS = 0.5 ** np.arange(12)  # step lengths tried
BLOCK = 2048  # rows whose features are in memory at once


class Nystrom:
    """Features (1, k(x, landmarks) M) with M M' the inverse of the landmarks' kernel."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.landmarks, self.gamma = landmarks, gamma
        values, vectors = np.linalg.eigh(self.kernel(landmarks))
        keep = values > 1e-10 * max(values[-1], 1e-300)
        self.map = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        shift = self.landmarks[0]
        a, b = x - shift, self.landmarks - shift
        sq = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
        return np.exp(-self.gamma * np.maximum(sq, 0.0))

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), self.kernel(x) @ self.map])

    @property
    def size(self) -> int:
        return self.map.shape[1] + 1


def landmarks(df: DataFrame, cols: list[str], n: int, seed: int) -> np.ndarray:
    """At most ``n`` distinct rows of ``cols``, the first by a seeded hash."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna().distinct()
    picked = rows.orderBy(F.xxhash64(F.lit(seed), *cols), *cols).limit(n).toArrow()
    return np.column_stack([picked.column(c).to_numpy() for c in cols]).astype(float)


class Problem:
    """One machine: for class ``cls`` against the rest (None: regression),
    trained without the rows of ``fold`` (None: with all)."""

    def __init__(self, cls: int | None = None, fold: int | None = None):
        self.cls, self.fold = cls, fold

    def terms(self, f: np.ndarray, y: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """(u, du/df): the loss is max(0, u)."""
        if self.cls is None:
            return np.abs(y - f) - epsilon, np.sign(f - y)
        sign = np.where(y == self.cls, 1.0, -1.0)
        return 1.0 - sign * f, -sign


def _rounded(u: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, u) with its corner rounded over (0, h): value, slope, curvature."""
    t = np.clip(u / h, 0.0, 1.0)
    return np.where(u < h, 0.5 * h * t * t, u - 0.5 * h), t, ((u > 0) & (u < h)) / h


def _scan(rows: DataFrame, run_block, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Sums over all rows of the arrays that ``run_block(x, y, fold)`` yields
    as (problem, array)."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
            fold = batch.column("fold").to_numpy()
            for at in range(0, len(y), BLOCK):
                part = slice(at, at + BLOCK)
                for j, v in run_block(x[part], y[part], fold[part]):
                    sums[j] = sums[j] + v if j in sums else v
        for j, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), j, dtype=np.int32)), pa.array(np.arange(len(v), dtype=np.int32)),
                 pa.array(v)], names=["j", "at", "v"])

    out = rows.mapInArrow(run, "j int, at int, v double").groupBy("j", "at").agg(F.sum("v").alias("v")).toArrow()
    j, at, v = (out.column(c).to_numpy() for c in ("j", "at", "v"))
    sums = {k: np.zeros(n) for k, n in sizes.items()}
    for k in sums:
        sums[k][at[j == k]] = v[j == k]
    return sums


def minimise(rows: DataFrame, basis: Nystrom, problems: list[Problem], C: float, epsilon: float,
             spread: float, start: float = 0.0) -> list[np.ndarray]:
    """Weights (intercept first) of each problem; ``rows`` has x, y, fold;
    intercepts begin at ``start``."""
    q = basis.size
    upper = np.triu_indices(q)
    ridge = np.concatenate([[0.0], np.ones(q - 1)])
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    w = [np.append(start, np.zeros(q - 1)) for _ in problems]

    for width in WIDTHS:
        h, open_ = width * spread, set(range(len(problems)))
        last: dict[int, float] = {}
        for _ in range(ROUNDS):
            now = {j: w[j] for j in sorted(open_)}

            def slopes(x, y, fold, now=now, h=h):
                z = shared.value.features(x)
                f = z @ np.column_stack(list(now.values()))
                for i, j in enumerate(now):
                    u, du = problems[j].terms(f[:, i], y, epsilon)
                    loss, d1, d2 = _rounded(u, h)
                    if problems[j].fold is not None:
                        use = fold != problems[j].fold
                        loss, d1, d2 = loss * use, d1 * use, d2 * use
                    bent = np.flatnonzero(d2)  # rows off the rounded corner have no curvature
                    zb = z if len(bent) == len(z) else z[bent]
                    hess = zb.T @ (zb * d2[bent, None])
                    yield j, np.concatenate([[loss.sum(), d1.sum()], z.T @ (d1 * du), hess[upper]])

            sums = _scan(rows, slopes, {j: 2 + q + len(upper[0]) for j in now})
            steps = {}
            for j, wj in now.items():
                s = sums[j]
                value = 0.5 * (ridge * wj) @ wj + C * s[0]
                grad = ridge * wj + C * s[2:2 + q]
                hess = np.zeros((q, q))
                hess[upper] = C * s[2 + q:]
                hess = hess + hess.T - np.diag(np.diag(hess))
                hess += np.diag(ridge + 1e-8 * (1.0 + np.abs(np.diag(hess))))
                hess[0, 0] += 1e-3 * C * s[1] / h  # when no row is on a rounded corner
                step = -np.linalg.solve(hess, grad)
                last[j] = value
                if -grad @ step > TOLERANCE * max(value, 1e-12):
                    steps[j] = step
            if not steps:
                break

            def values(x, y, fold, steps=steps, now=now, h=h):
                z = shared.value.features(x)
                f, d = z @ np.column_stack([now[j] for j in steps]), z @ np.column_stack(list(steps.values()))
                for i, j in enumerate(steps):
                    fj, dj, yj = f[:, i], d[:, i], y
                    if problems[j].fold is not None:
                        use = fold != problems[j].fold
                        fj, dj, yj = fj[use], dj[use], y[use]
                    yield j, np.array([_rounded(problems[j].terms(fj + t * dj, yj, epsilon)[0], h)[0].sum()
                                       for t in LENGTHS])

            tried = _scan(rows, values, {j: len(LENGTHS) for j in steps})
            open_ = set()
            for j, step in steps.items():
                points = [now[j] + t * step for t in LENGTHS]
                costs = np.array([0.5 * (ridge * p) @ p for p in points]) + C * tried[j]
                best = int(np.argmin(costs))
                if costs[best] < last[j]:
                    w[j] = points[best]
                    if last[j] - costs[best] > TOLERANCE * max(last[j], 1e-12):
                        open_.add(j)
            if not open_:
                break
    return w


def training_rows(df: DataFrame, cols: list[str], label: str, folds: int = 1) -> DataFrame:
    """x, y and a fold dealt by a hash of the row; rows with a null are left out."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), *cols, label), F.lit(folds)).cast("int")
    return df.select(*cols, label).dropna().select(vector(cols).alias("x"), F.col(label).cast("double").alias("y"),
                                                   fold.alias("fold"))


def vector(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def with_margins(df: DataFrame, x: Column, basis: Nystrom, weights: np.ndarray, out: str = "margins",
                 fold: str | None = None) -> DataFrame:
    """``df`` with the array column ``out`` of decision values, one a machine;
    with ``fold``, ``weights`` holds a set of machines for each fold.  Null
    inputs have null values."""
    shared = df.sparkSession.sparkContext.broadcast((basis, weights))
    packed = df.select(F.struct("*").alias("_row"), x.alias("x"),
                       (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))

    def run(batches):
        basis, weights = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column("x").to_pylist()], dtype=float)
            known = ~np.isnan(x).any(axis=1)
            at = batch.column("fold").to_numpy()
            values = np.zeros((n, weights.shape[-2]))
            for begin in range(0, n, BLOCK):
                part = slice(begin, begin + BLOCK)
                z = basis.features(np.nan_to_num(x[part]))
                values[part] = np.einsum("nq,ncq->nc", z, weights[at[part]]) if weights.ndim == 3 else z @ weights.T
            offsets = np.append(np.arange(n) * values.shape[1], n * values.shape[1])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), lists, pa.array(known)], names=["_row", out, "_known"])

    schema = (T.StructType().add("_row", packed.schema["_row"].dataType).add(out, T.ArrayType(T.DoubleType()))
              .add("_known", T.BooleanType()))
    return packed.mapInArrow(run, schema).select("_row.*", F.when(F.col("_known"), F.col(out)).alias(out))
