"""The slow path, kept small: vectorised (Arrow) pandas helpers.

``text_udf`` wraps a pandas Series -> Series function as a pandas UDF for
per-row text logic that SQL expressions cannot express; it sees at most
``ARROW_ROWS`` texts at once.  ``group_apply``
runs a pandas function per group in two phases -- partial results per
partition with ``mapInPandas``, merged by a Spark aggregate -- so no group,
however large, is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches


def text_udf(fn: Callable[[pd.Series], pd.Series], return_type: str = "string"):
    spark = SparkSession.getActiveSession()
    if spark is not None:
        small_batches(spark)

    @F.pandas_udf(return_type)
    def run(s: pd.Series) -> pd.Series:
        return fn(s)
    return run


def group_apply(df: DataFrame, by: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame],
                partial_schema: str, merge: dict[str, Column], finish: dict[str, Column]) -> DataFrame:
    """Two-phase grouped computation.

    ``partial(pdf)`` receives one Arrow batch of rows and returns partial
    aggregates per group (columns ``by`` + partial columns);
    ``merge`` combines partials per group (Spark aggregate expressions) and
    ``finish`` maps the merged columns to the result.
    """
    def per_batch(batches):
        for pdf in batches:
            if not pdf.empty:
                yield partial(pdf)

    parts = df.mapInPandas(per_batch, partial_schema)
    merged = parts.groupBy(*by).agg(*[e.alias(k) for k, e in merge.items()])
    return merged.select(*by, *[e.alias(k) for k, e in finish.items()])
