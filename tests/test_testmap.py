"""The five tables derived from the test tables are identical in Spark and DuckDB."""

from __future__ import annotations

import pytest

from lossgrid.sources.schemas import SCHEMAS, TABLE_ORDER, widen_ids
from lossgrid.sources.testmap import mapped_portfolio, with_views
from tests.conftest import SF_SMALL
from tests.parity import compare_frames, duck_connection


@pytest.fixture(scope="module")
def t(spark):
    return mapped_portfolio(spark, SF_SMALL)


@pytest.mark.parametrize("name", TABLE_ORDER)
def test_mapped_table_equals_sql_view(t, name):
    con = duck_connection(SF_SMALL)
    assert compare_frames(getattr(t, name), con, with_views(f"SELECT * FROM {name}")) == []


@pytest.mark.parametrize("name", TABLE_ORDER)
def test_mapped_table_has_the_declared_schema(t, name):
    got = [(f.name, f.dataType) for f in getattr(t, name).schema]
    assert got == [(f.name, f.dataType) for f in widen_ids(SCHEMAS[name])]
