"""Every SQL-checkable query against its DuckDB twin on the sf0.01 tables."""

import pytest

import __spark_entry__ as E
from tapline.plans.check import compare

from conftest import SF_CHECK

ORACLES = E.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_duckdb(spark, duck, key):
    r = compare(spark, duck, key, E.queries()[key], ORACLES[key], SF_CHECK)
    assert r["status"] == "ok", r


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["target", "class", "n", "pct"]
    df.collect()
