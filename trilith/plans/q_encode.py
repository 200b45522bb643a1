"""Registered queries: encoding, scaling, target transforms (§2.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode as E
from ..session import stored
from ..sources.items import MEASURE_COLUMNS, item_view
from .common import capped_items, items_sql, label_items
from .registry import register

MEAS = MEASURE_COLUMNS


@register("ordinal_encode", items_sql("""
SELECT item_id, source, CAST(coalesce(e.code, -1) AS INTEGER) AS source_enc
FROM capped LEFT JOIN (
  SELECT source AS s, row_number() OVER (ORDER BY source) - 1 AS code
  FROM (SELECT DISTINCT source FROM capped WHERE source IS NOT NULL)) e ON e.s = capped.source"""))
def q_ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(item_view(spark, sf_dir).select("item_id", "source"), "sources")
    return E.ordinal_encode(df, "source", out="source_enc")


_LABEL_CTE = """,
lab AS (SELECT categorie AS c, CAST(row_number() OVER (ORDER BY categorie) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT categorie FROM capped WHERE categorie IS NOT NULL))"""


@register("label_encode", items_sql(
    "SELECT item_id, categorie, lab.code AS categorie_enc FROM capped LEFT JOIN lab ON lab.c = capped.categorie",
    _LABEL_CTE))
def q_label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = label_items(spark, sf_dir)
    return E.label_encode(df, "categorie", out="categorie_enc")[0]


@register("label_decode", items_sql(
    "SELECT item_id, lab.code AS categorie_enc, lab.c AS categorie_dec FROM capped LEFT JOIN lab ON lab.c = capped.categorie",
    _LABEL_CTE))
def q_label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = label_items(spark, sf_dir)
    enc, labels = E.label_encode(df, "categorie", out="categorie_enc")
    return E.label_decode(enc, "categorie_enc", labels, "categorie_dec").select(
        "item_id", "categorie_enc", "categorie_dec")


def _scale_sql(with_mean: bool, inverse: bool = False) -> str:
    mom = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                    for c in MEAS)
    cols = []
    for c in MEAS:
        z = f"({c} - m_{c}) / s_{c}" if with_mean else f"{c} / s_{c}"
        if inverse:
            z = f"(({z}) * s_{c} + m_{c})"
        cols.append(f"round({z}, 6) AS {c}")
    return items_sql(f"SELECT item_id, {', '.join(cols)} FROM capped, mom", f",\nmom AS (SELECT {mom} FROM capped)")


def _scaled(spark, sf_dir, with_mean=True):
    df = capped_items(spark, sf_dir).select("item_id", *MEAS)
    params = E.fit_scaler(df, MEAS, with_mean=with_mean)
    return E.apply_scaler(df, params), params


def _round(df: DataFrame) -> DataFrame:
    return df.select("item_id", *[F.round(c, 6).alias(c) for c in MEAS])


@register("standard_scale", _scale_sql(True))
def q_standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_scaled(spark, sf_dir)[0])


@register("scale_no_mean", _scale_sql(False))
def q_scale_no_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_scaled(spark, sf_dir, with_mean=False)[0])


@register("inverse_scale", _scale_sql(True, inverse=True))
def q_inverse_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, params = _scaled(spark, sf_dir)
    return _round(E.inverse_scale(z, params))


@register("profile_normalise", items_sql(
    "SELECT item_id, round(poids / 500.0, 6) AS poids, round(volume / 500.0, 6) AS volume, "
    "round(conductivite, 6) AS conductivite, round(opacite, 6) AS opacite, round(rigidite / 10.0, 6) AS rigidite FROM capped"))
def q_profile_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = capped_items(spark, sf_dir).select("item_id", *MEAS)
    return _round(E.profile_normalise(df, {"poids": 500.0, "volume": 500.0, "conductivite": 1.0,
                                           "opacite": 1.0, "rigidite": 10.0}))


@register("log_target", items_sql(
    "SELECT item_id, round(ln(1 + prix_revente), 6) AS prix_log, "
    "round(exp(ln(1 + prix_revente)) - 1, 6) AS prix_back FROM capped"))
def q_log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = capped_items(spark, sf_dir).select("item_id", "prix_revente")
    df = E.exp_target(E.log_target(df, "prix_revente", "prix_log"), "prix_log", "prix_back")
    return df.select("item_id", F.round("prix_log", 6).alias("prix_log"), F.round("prix_back", 6).alias("prix_back"))
