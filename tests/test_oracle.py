"""Every SQL-checkable registered query equals its DuckDB oracle (sf0.001 here; the
driver checks sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = os.environ.get("QM_TEST_SF", "/root/testdata/sf0.001")
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["ok"], r


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "source" in df.columns
