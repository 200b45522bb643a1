"""Serving-side scoring (§2.10 batch_score): one ``PipelineModel`` carries
every fitted step, so training and serving apply identical transforms.

Fitted preprocessing constants (imputation values, caps, scaler moments,
encoder dictionaries) are embedded in a ``SQLTransformer`` stage -- plain
SQL expressions with literals, JVM-side and saved with the model.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v))


def preprocessing_stage(fill: dict | None = None, caps: dict | None = None, scaler: dict | None = None,
                        ordinal: dict | None = None) -> SQLTransformer:
    """Impute -> cap -> scale numeric columns, ordinal-encode categorical
    ones; all constants were fitted on the training split."""
    fill, caps, scaler, ordinal = fill or {}, caps or {}, scaler or {}, ordinal or {}
    cols = sorted(set(fill) | set(caps) | set(scaler))
    exprs = []
    for c in cols:
        e = f"`{c}`"
        if c in fill and fill[c] is not None:
            e = f"coalesce({e}, {_lit(fill[c])})"
        if c in caps and caps[c][2] is not None:
            lo, hi = caps[c][2], caps[c][3]
            e = f"CASE WHEN {e} IS NULL THEN NULL ELSE least(greatest({e}, {_lit(lo)}), {_lit(hi)}) END"
        if c in scaler:
            m, s = scaler[c]
            e = f"(({e}) - {_lit(m)}) / {_lit(s)}"
        exprs.append(f"{e} AS `{c}__p`")
    for c, values in ordinal.items():
        cases = " ".join(f"WHEN `{c}` = {_lit(v)} THEN {float(i)}" for i, v in enumerate(values))
        exprs.append(f"CASE {cases} ELSE -1.0 END AS `{c}__p`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def processed(cols: list[str]) -> list[str]:
    return [f"{c}__p" for c in cols]


def fit_classifier_pipeline(train: DataFrame, prep: SQLTransformer, feature_cols: list[str], label: str = "label",
                            C: float = 1.0) -> PipelineModel:
    n = train.count()
    return Pipeline(stages=[
        prep,
        VectorAssembler(inputCols=processed(feature_cols), outputCol="clf_features", handleInvalid="error"),
        LogisticRegression(featuresCol="clf_features", labelCol=label, predictionCol="clf_pred",
                           probabilityCol="clf_prob", rawPredictionCol="clf_raw", family="multinomial",
                           regParam=1.0 / (C * n), standardization=False),
    ]).fit(train)


def fit_price_pipeline(train: DataFrame, prep: SQLTransformer, feature_cols: list[str], target: str,
                       alpha: float = 1.0) -> PipelineModel:
    """Ridge on log1p(target) (label made inside the pipeline)."""
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.log1p(target)).alias("s")).first()
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, log1p(`{target}`) AS price_label FROM __THIS__"),
        prep,
        VectorAssembler(inputCols=processed(feature_cols), outputCol="reg_features", handleInvalid="error"),
        LinearRegression(featuresCol="reg_features", labelCol="price_label", predictionCol="price_log",
                         regParam=alpha * (st["s"] or 1.0) / st["n"], elasticNetParam=0.0, standardization=False),
    ]).fit(train)


def batch_score(df: DataFrame, clf: PipelineModel, labels: list[str], reg: PipelineModel | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """prediction (label), probability map, confidence = max probability
    (4 decimals) and price = expm1(regression) (2 decimals, 0.0 when it
    cannot be computed).  A classifier without probabilities reports 1.0."""
    keep = keep or []
    out = clf.transform(df)
    lab = F.array(*[F.lit(v) for v in labels])
    if "clf_prob" in out.columns:
        prob = vector_to_array(F.col("clf_prob"))
    else:
        prob = F.transform(lab, lambda _, i: F.when(i == F.col("clf_pred").cast("int"), 1.0).otherwise(0.0))
    out = out.withColumn("_prob", prob)
    res = out.select(*keep, *(c for c in df.columns if c not in keep),
                     F.element_at(lab, F.col("clf_pred").cast("int") + 1).alias("prediction"),
                     F.map_from_arrays(lab, F.col("_prob")).alias("probabilities"),
                     F.round(F.array_max("_prob"), 4).alias("confidence"))
    if reg is not None:
        priced = reg.transform(res)
        res = priced.select(*res.columns, F.coalesce(F.round(F.expm1("price_log"), 2), F.lit(0.0)).alias("price"))
    else:
        res = res.withColumn("price", F.lit(0.0))
    return res
