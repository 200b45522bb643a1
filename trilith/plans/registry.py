"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and reads the test tables
(or data Spark derives from them).  Oracle SQL runs on DuckDB over the same
parquet files, with every table pre-registered as a view.
"""

from __future__ import annotations

import importlib
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key!r}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


MODULES = ("flagship", "q_clean", "q_cluster", "q_composite", "q_encode", "q_eval", "q_impute", "q_io",
           "q_models", "q_profile", "q_quality", "q_split", "q_stream", "q_text")
LOAD_ERRORS: dict[str, Exception] = {}


def load_all() -> None:
    """Import every module that registers queries.

    A module that cannot be imported is recorded in ``LOAD_ERRORS`` and named
    in a warning; the queries of the other modules stay available.  The tests
    require ``LOAD_ERRORS`` to be empty.
    """
    for name in MODULES:
        try:
            importlib.import_module(f"{__package__}.{name}")
        except Exception as e:  # noqa: BLE001
            LOAD_ERRORS[name] = e
            warnings.warn(f"queries of {name} are not available: {e!r}", stacklevel=2)
