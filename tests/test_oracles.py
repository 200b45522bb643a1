"""Registered queries against their DuckDB oracles on the smallest tables
(the driver repeats this at sf0.01 for every key)."""

import pytest

import __spark_entry__ as entry
from trilith.plans.oracle_check import compare, duck

from .conftest import SMALL

SLOW = {"impute_knn"}
ORACLES = entry.oracle_sql()
KEYS = sorted(k for k in ORACLES if k not in SLOW)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    fn = entry.queries()[key]
    res = compare(spark, key, fn, ORACLES[key], SMALL, con)
    assert res["columns_match"], res
    assert res["match"], res
    assert res["order_match"] and not res["type_diff"], res


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["categorie", "source", "n_items", "mean_poids", "mean_prix", "share"]
