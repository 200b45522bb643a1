"""Evaluation, selection and scoring helpers (§2.10).

Classification metrics are computed from the confusion counts -- one
``groupBy(group..., y, p).count()`` with map-side partial aggregation -- so
the data is scanned once and everything after that runs on a table with at
most (groups x classes^2) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CATEGORIES, REQUEST_BOUNDS, RULE_WEIGHTS


def confusion_counts(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.groupBy(*by, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))


def per_class_counts(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(by..., label, tp, true_sum, pred_sum) for every label seen in y or p."""
    by = by or []
    cc = confusion_counts(df, y, p, by)
    side = cc.select(*by, F.explode(F.array(
        F.struct(F.col("_y").cast("string").alias("label"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).alias("tp"),
                 F.col("_n").alias("t"), F.lit(0).cast("long").alias("pr")),
        F.struct(F.col("_p").cast("string").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("t"), F.col("_n").alias("pr")))).alias("s"))
    return (side.where(F.col("s.label").isNotNull())
            .groupBy(*by, F.col("s.label").alias("label"))
            .agg(F.sum("s.tp").alias("tp"), F.sum("s.t").alias("true_sum"), F.sum("s.pr").alias("pred_sum")))


def _prf(tp: Column, t: Column, pr: Column):
    prec = F.coalesce(F.try_divide(tp.cast("double"), pr.cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp.cast("double"), t.cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide((2 * tp).cast("double"), (t + pr).cast("double")), F.lit(0.0))
    return prec, rec, f1


def accuracy(df: DataFrame, y: str, p: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    by = by or []
    return df.groupBy(*by).agg(F.round(F.avg((F.col(y) == F.col(p)).cast("double")), digits).alias("accuracy"))


def f1_macro(df: DataFrame, y: str, p: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Unweighted mean of per-class F1 over the labels present in y or p;
    an undefined F1 counts as 0."""
    by = by or []
    pc = per_class_counts(df, y, p, by)
    _, _, f1 = _prf(F.col("tp"), F.col("true_sum"), F.col("pred_sum"))
    return pc.groupBy(*by).agg(F.round(F.avg(f1), digits).alias("f1_macro"))


def _row(label: str, p: str, r: str, f: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1"), F.col("_n").alias("support"))


def classification_report(df: DataFrame, y: str, p: str, digits: int = 6) -> DataFrame:
    """Per class precision / recall / F1 / support, then the accuracy,
    macro-average and weighted-average rows."""
    pc = per_class_counts(df, y, p)
    prec, rec, f1 = _prf(F.col("tp"), F.col("true_sum"), F.col("pred_sum"))
    rows = pc.select("label", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                     F.col("true_sum").alias("support"), "tp")
    total = F.sum("support")
    summary = rows.agg(
        F.sum("tp").alias("_tp"), total.alias("_n"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), total.cast("double")).alias("_wp"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), total.cast("double")).alias("_wr"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), total.cast("double")).alias("_wf"))
    extra = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 F.try_divide(F.col("_tp").cast("double"), F.col("_n").cast("double")).alias("f1"),
                 F.col("_n").alias("support")),
        _row("macro avg", "_mp", "_mr", "_mf"), _row("weighted avg", "_wp", "_wr", "_wf"))).alias("s")
    ).select("s.*")
    out = rows.drop("tp").unionByName(extra)
    return out.select("label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: list | None = None) -> DataFrame:
    """(true, predicted, count) for every pair of labels, zeros kept.

    The label domain is collected (bounded by the number of classes) and
    the pairs are generated from it; counts come from one aggregate.
    """
    cc = confusion_counts(df, y, p)
    if labels is None:
        seen = cc.select(F.explode(F.array(F.col("_y").cast("string"), F.col("_p").cast("string"))).alias("l")) \
                 .where(F.col("l").isNotNull()).distinct().collect()
        labels = sorted(r[0] for r in seen)
    spark = df.sparkSession
    arr = F.array(*[F.lit(str(v)) for v in labels])
    pairs = (spark.range(1).select(F.explode(arr).alias("true_label"))
             .select("true_label", F.explode(arr).alias("pred_label")))
    counts = cc.select(F.col("_y").cast("string").alias("true_label"),
                       F.col("_p").cast("string").alias("pred_label"), "_n")
    return (pairs.join(F.broadcast(counts), ["true_label", "pred_label"], "left")
            .select("true_label", "pred_label", F.coalesce("_n", F.lit(0)).cast("long").alias("count")))


def regression_metrics(df: DataFrame, y_log: str, p_log: str, by: list[str] | None = None,
                       digits: int = 6) -> DataFrame:
    """RMSE and MAE after expm1 (original scale), R2 on the log scale.

    The total sum of squares is the population variance times the count, one
    aggregate whose merged moments do not cancel; no row is joined or moved
    but for the partial aggregates.
    """
    by = by or []
    y, p = F.col(y_log), F.col(p_log)
    ey, ep = F.expm1(y), F.expm1(p)
    g = df.groupBy(*by).agg(
        F.sqrt(F.avg(F.pow(ey - ep, 2))).alias("rmse"), F.avg(F.abs(ey - ep)).alias("mae"),
        F.sum(F.pow(y - p, 2)).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))
    return g.select(*by, F.round("rmse", digits).alias("rmse"), F.round("mae", digits).alias("mae"),
                    F.round(r2, digits).alias("r2_log"))


def residuals(df: DataFrame, y_log: str, p_log: str) -> DataFrame:
    """actual, predicted and residual on the log scale, per row."""
    return df.withColumn("residual", F.col(y_log) - F.col(p_log))


def leaderboard(results: DataFrame, metric: str, name_cols: list[str]) -> DataFrame:
    """Results ranked by metric (descending), ties by name."""
    w = Window.orderBy(F.desc(metric), *[F.asc(c) for c in name_cols])
    return results.withColumn("rank", F.row_number().over(w).cast("int"))


def best_run(results: DataFrame, metric: str, name_cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Top-1 by metric (ties: names ascending), optionally per group."""
    by = by or []
    if not by:
        return results.orderBy(F.desc(metric), *[F.asc(c) for c in name_cols]).limit(1)
    w = Window.partitionBy(*by).orderBy(F.desc(metric), *[F.asc(c) for c in name_cols])
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def results_pivot(results: DataFrame, row: str, col: str, metric: str, values: list[str],
                  digits: int = 4) -> DataFrame:
    """row x col matrix of a metric (pivot values passed explicitly)."""
    return results.groupBy(row).pivot(col, values).agg(F.round(F.first(metric), digits))


def score_delta(results: DataFrame, name: str, baseline: str, metric: str,
                by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Each run's metric minus the baseline run's metric (per group)."""
    by = by or []
    base = results.where(F.col(name) == F.lit(baseline)).select(*by, F.col(metric).alias("_base"))
    if by:
        j = results.join(base, by)
    else:
        b = base.first()
        j = results.withColumn("_base", F.lit(b["_base"] if b else None).cast("double"))
    return j.select(*results.columns, F.round(F.col(metric) - F.col("_base"), digits).alias("delta"))


# ------------------------------------------------------------ requests and rules

def validate_requests(df: DataFrame, bounds: dict | None = None, required: list[str] | None = None) -> DataFrame:
    """Adds ``is_valid`` and ``reasons`` (';'-joined): missing required
    measures and measures outside their bounds."""
    bounds = bounds or REQUEST_BOUNDS
    required = required or list(bounds)
    checks = []
    for c in required:
        checks.append(F.when(F.col(c).isNull(), F.lit(f"{c} missing")))
    for c, (lo, lo_inc, hi, hi_inc) in bounds.items():
        x = F.col(c)
        ok = (x >= lo if lo_inc else x > lo) & (x <= hi if hi_inc else x < hi)
        checks.append(F.when(x.isNotNull() & ~ok, F.lit(f"{c} out of range")))
    reasons = F.filter(F.array(*checks), lambda r: r.isNotNull())
    return df.withColumn("reasons", F.array_join(reasons, ";")).withColumn("is_valid", F.size(reasons) == 0)


def _rule_scores(c: Column, o: Column, r: Column) -> list[Column]:
    out = []
    for k in CATEGORIES:
        w = RULE_WEIGHTS[k]
        terms = []
        for key, coef in w.items():
            if key == "const":
                continue
            v = {"c": c, "o": o, "r": r / 10, "1-c": (1 - c), "1-o": (1 - o), "1-r": (1 - r / 10)}[key]
            terms.append(v * coef)
        s = terms[0]
        for t in terms[1:]:
            s = s + t
        out.append(s + w["const"])
    return out


def rule_probabilities(df: DataFrame, c: str, o: str, r: str, out: str = "proba") -> DataFrame:
    """Four linear physical scores normalised to sum 1, as a map."""
    sc = _rule_scores(F.col(c), F.col(o), F.col(r))
    t = sc[0]
    for s in sc[1:]:
        t = t + s
    probs = [s / t for s in sc]
    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(k) for k in CATEGORIES]), F.array(*probs)))


def argmax_first(names: list[str], vals: list[Column]) -> Column:
    """Name of the largest value; the first declared wins ties; NULL if any
    value is NULL."""
    pred = F.when(sum((v.isNull().cast("int") for v in vals), F.lit(0)) > 0, F.lit(None).cast("string"))
    for i, k in enumerate(names):
        cond = F.lit(True)
        for j in range(len(names)):
            if j < i:
                cond = cond & (vals[i] > vals[j])
            elif j > i:
                cond = cond & (vals[i] >= vals[j])
        pred = pred.when(cond, F.lit(k))
    return pred


def rule_score(df: DataFrame, c: str, o: str, r: str, digits: int = 6) -> DataFrame:
    """Rule classifier: prediction = arg-max of the normalised scores,
    confidence = its probability."""
    p = rule_probabilities(df, c, o, r, "_proba")
    vals = [F.col("_proba")[k] for k in CATEGORIES]
    pred = argmax_first(CATEGORIES, vals)
    return (p.withColumn("prediction", pred)
            .withColumn("confidence", F.round(F.try_element_at(F.col("_proba"), F.col("prediction")), digits))
            .drop("_proba"))


def ranked_probabilities(df: DataFrame, id_col: str, proba: str, digits: int = 6,
                         order: list[str] | None = None) -> DataFrame:
    """(id, category, probability, rank) rows, descending probability, ties
    in declaration order; the window holds one item's classes only."""
    order = order or CATEGORIES
    pos = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    ex = df.select(id_col, F.explode(proba).alias("category", "probability"))
    w = Window.partitionBy(id_col).orderBy(F.desc("probability"), F.try_element_at(pos, F.col("category")))
    return ex.select(id_col, "category", F.round("probability", digits).alias("probability"),
                     F.row_number().over(w).cast("int").alias("rank"))
