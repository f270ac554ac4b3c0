"""Every named query agrees with its DuckDB oracle (sf0.001, exact values)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lossgrid.plans.registry import IO_QUERIES
from lossgrid.plans.registry import QUERIES as PORTFOLIO_QUERIES
from tests.conftest import SF_SMALL
from tests.parity import compare, duck_connection

# The optional training-data queries have their own tests.
QUERIES = {name: entry.queries()[name] for name in PORTFOLIO_QUERIES | IO_QUERIES}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, SF_SMALL, QUERIES[name], ORACLE[name]) == []


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 4
    assert "loss_ratio_pct" in df.columns
