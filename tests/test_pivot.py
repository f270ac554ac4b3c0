"""Pivot over written cells, histogram over a staged column, cohort years as bits."""

from __future__ import annotations

import datetime as dt

import pytest

from lossgrid.operators.pivot import pivot_cells
from lossgrid.plans import sql_track
from lossgrid.plans.registry import QUERIES
from lossgrid.sources.testmap import mapped_portfolio
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_come_from_the_cells(spark):
    cells = spark.createDataFrame([("x", "b", 1.0), ("x", "a", 2.0), ("y", "c d.e", 3.0), ("z", None, 4.0), (None, "a", 5.0)], "r string, c string, v double")
    wide = pivot_cells(cells, "r", "c", "v")
    assert wide.columns == ["r", "a", "b", "c d.e"]
    assert sorted(map(str, map(tuple, wide.collect()))) == sorted(map(str, [("x", 2.0, 1.0, None), ("y", None, None, 3.0), ("z", None, None, None), (None, 5.0, None, None)]))
    assert pivot_cells(cells.limit(0), "r", "c", "v").columns == ["r"]
    assert pivot_cells(cells.where("c is null"), "r", "c", "v").collect() == [("z",)]
    with pytest.raises(ValueError):
        pivot_cells(cells, "r", "c", "v", most=2)


@pytest.mark.parametrize("name", ["n13b_country_product_pivot", "v07_lr_histogram", "n16_claim_amount_describe", "n19_clv_concentration"])
def test_facts_are_planned_once(spark, name):
    """What the result reads is a small written table; the facts lie below the write alone."""
    plan = _plan(QUERIES[name](mapped_portfolio(spark, SF_SMALL)))
    assert "lineitem" not in plan and plan.count("FileScan") == 1


def test_the_pivot_joins_the_facts_in_one_job(spark, monkeypatch):
    from lossgrid.operators import pivot

    written = []
    real = pivot.materialize
    monkeypatch.setattr(pivot, "materialize", lambda df, name: written.append(_plan(df)) or real(df, name))
    QUERIES["n13b_country_product_pivot"](mapped_portfolio(spark, SF_SMALL)).collect()
    assert len(written) == 1 and written[0].count("lineitem") == 2  # premiums and claims


def _policies(spark, rows):
    schema = "policy_id long, client_id long, product_type string, start_date date, end_date date, agent_id long"
    return spark.createDataFrame([(i, c, "Auto", None if y is None else dt.date(y, 5, 1), None, 1) for i, (c, y) in enumerate(rows)], schema)


def test_cohort_years_of_the_whole_calendar(spark):
    rows = [(1, 1899), (1, 1900), (1, 2155), (1, 2156), (1, 2156), (2, 2020), (2, 2020), (2, 1963), (2, 1964), (3, 1), (3, 9999), (4, None), (None, 2020), (5, 2027), (5, None)]
    got = sorted(map(tuple, sql_track.client_years(_policies(spark, rows)).collect()))
    want = set()
    for client in {c for c, y in rows if c is not None}:
        years = {y for c, y in rows if c == client and y is not None}
        want |= {(client, min(years), y) for y in years}
    assert got == sorted((first, y) for _, first, y in want)


def test_cohort_years_need_hash_aggregates_only(spark):
    plan = _plan(QUERIES["s07_cohort_retention"](mapped_portfolio(spark, SF_SMALL)))
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert "PushedFilters: [IsNotNull(o_custkey), " in plan or "PushedFilters" in plan
