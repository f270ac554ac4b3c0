"""All named queries on an adversarial portfolio vs DuckDB brute force."""

from __future__ import annotations

import duckdb
import pytest

from lossgrid.plans.oracle_sql import ORACLE_BODIES
from lossgrid.plans.registry import QUERIES
from lossgrid.sources.readers import Portfolio
from lossgrid.sources.schemas import SCHEMAS
from tests.adversarial import build
from tests.parity import compare_frames


@pytest.fixture(scope="module")
def tables():
    return build()


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for name, table in tables.items():
        c.register(name, table)
    return c


@pytest.fixture(scope="module")
def portfolio(spark, tables):
    frames = {
        name: spark.createDataFrame([tuple(r.values()) for r in table.to_pylist()], SCHEMAS[name])
        for name, table in tables.items()
    }
    return Portfolio(**frames)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_brute_force(portfolio, con, name):
    assert compare_frames(QUERIES[name](portfolio), con, ORACLE_BODIES[name]) == []


def _portfolio_and_con(spark, tables):
    c = duckdb.connect()
    for name, table in tables.items():
        c.register(name, table)
    frames = {
        name: spark.createDataFrame([tuple(r.values()) for r in table.to_pylist()], SCHEMAS[name])
        for name, table in tables.items()
    }
    return Portfolio(**frames), c


@pytest.fixture(scope="module")
def small_cases(spark):
    cases = {f"seed{s}": build(seed=s, n_policies=40) for s in (1, 2, 3)}
    empty = {name: table.slice(0, 0) for name, table in build(seed=4, n_policies=5).items()}
    cases["empty"] = empty
    return {k: _portfolio_and_con(spark, v) for k, v in cases.items()}


@pytest.mark.parametrize("case", ["seed1", "seed2", "seed3", "empty"])
def test_small_and_empty_portfolios(small_cases, case):
    t, c = small_cases[case]
    failures = {}
    for name in sorted(QUERIES):
        problems = compare_frames(QUERIES[name](t), c, ORACLE_BODIES[name])
        if problems:
            failures[name] = problems
    assert failures == {}
