"""The SQL-track statements also run as text on Spark SQL over registered views.

They are the brute-force form (premiums x claims joined row by row); their
results must equal the pre-aggregated DataFrame plans.
"""

from __future__ import annotations

import pytest

from lossgrid.plans import sql_track
from lossgrid.plans.oracle_sql import ORACLE_BODIES
from lossgrid.sources.testmap import mapped_portfolio
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def t(spark):
    p = mapped_portfolio(spark, SF_SMALL)
    p.register()
    return p


@pytest.mark.parametrize("name", sorted(sql_track.QUERIES))
def test_statement_text_on_spark_sql_equals_dataframe_plan(spark, t, name):
    text = spark.sql(ORACLE_BODIES[name])
    plan = sql_track.QUERIES[name](t).select(*text.columns)
    assert sorted(map(repr, map(tuple, text.collect()))) == sorted(map(repr, map(tuple, plan.collect())))
