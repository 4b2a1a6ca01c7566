"""Every registered query against its SQL oracle (DuckDB) on the smallest
driver tables: same columns, same rows, same values."""

import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from oracle_check import compare, duck

from tablelens.plans import catalog

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, QUERIES[key], ORACLES.get(key), SF_SMALL)
    assert r["ok"], r


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 11
