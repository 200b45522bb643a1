"""Registered queries: filters, projections, predicates (§2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import TEXT_ONLY_DEFAULTS, UNLABELLED
from ..operators import clean as C
from ..sources.items import ITEM_COLUMNS, item_view
from .common import clean_view, items_sql
from .registry import register

MEASURES_MAP = {"poids": "Poids", "volume": "Volume", "conductivite": "Conductivite",
                "opacite": "Opacite", "rigidite": "Rigidite"}


@register("null_out_of_range", items_sql(f"SELECT {', '.join(ITEM_COLUMNS)} FROM clean"))
def q_null_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_view(spark, sf_dir)


@register("split_labelled", items_sql(
    "SELECT item_id, categorie, CASE WHEN categorie IS NULL THEN 'unlabelled' ELSE 'labelled' END AS part FROM items"))
def q_split_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, unl = C.split_labelled(item_view(spark, sf_dir).select("item_id", "categorie"), "categorie")
    return lab.withColumn("part", F.lit("labelled")).unionByName(unl.withColumn("part", F.lit("unlabelled")))


@register("drop_null_subset", items_sql(
    f"SELECT {', '.join(ITEM_COLUMNS)} FROM clean WHERE poids IS NOT NULL AND volume IS NOT NULL"))
def q_drop_null_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_null_subset(clean_view(spark, sf_dir), ["poids", "volume"])


@register("coerce_numeric", items_sql(
    "SELECT item_id, TRY_CAST(CAST(poids AS VARCHAR) AS DOUBLE) AS poids_txt, "
    "TRY_CAST(source AS DOUBLE) AS source_txt, TRY_CAST(CAST(rigidite AS VARCHAR) AS DOUBLE) AS rigidite_txt FROM items"))
def q_coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = item_view(spark, sf_dir).select(
        "item_id", F.col("poids").cast("string").alias("poids_txt"), F.col("source").alias("source_txt"),
        F.col("rigidite").cast("string").alias("rigidite_txt"))
    return C.coerce_numeric(raw, ["poids_txt", "source_txt", "rigidite_txt"])


@register("fill_default", items_sql(
    f"SELECT item_id, coalesce(categorie, '{UNLABELLED}') AS categorie, coalesce(source, '') AS source FROM items"))
def q_fill_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = item_view(spark, sf_dir).select("item_id", "categorie", "source")
    return C.fill_default(df, {"categorie": UNLABELLED, "source": ""})


@register("replace_values", items_sql(
    "SELECT item_id, CASE WHEN categorie = 'AUTOMOBILE' THEN NULL WHEN categorie = 'BUILDING' THEN 'CONSTRUCTION' "
    "ELSE categorie END AS categorie FROM items"))
def q_replace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = item_view(spark, sf_dir).select("item_id", "categorie")
    return C.replace_values(df, "categorie", {"AUTOMOBILE": None, "BUILDING": "CONSTRUCTION"})


FEATURES = ["poids", "volume", "conductivite", "opacite", "rigidite", "prix_revente"]


@register("select_features", items_sql(f"SELECT item_id, {', '.join(FEATURES)} FROM clean"))
def q_select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_features(clean_view(spark, sf_dir), ["item_id", *FEATURES], target="categorie")


_DEFAULTS = {k: TEXT_ONLY_DEFAULTS[v] for k, v in MEASURES_MAP.items()}


@register("serving_defaults", items_sql(
    "SELECT item_id, " + ", ".join(f"coalesce({k}, {float(v)}) AS {k}" for k, v in _DEFAULTS.items())
    + ", 0 AS source_enc FROM items"))
def q_serving_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = item_view(spark, sf_dir).select("item_id", *_DEFAULTS)
    return C.serving_defaults(df, {**{k: float(v) for k, v in _DEFAULTS.items()},
                                   "source_enc": TEXT_ONLY_DEFAULTS["Source_enc"]})
