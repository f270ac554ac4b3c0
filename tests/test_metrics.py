"""Numeric conventions of the helpers, checked against Python / numpy."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from lossgrid.functions import labels as L
from lossgrid.functions.metrics import ieee_ratio, ratio_exceeds, round_even, round_sql


def _eval(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


def test_round_even_is_numpy_round(spark):
    rng = np.random.default_rng(5)
    xs = list(rng.normal(0, 1000, 400)) + [0.25, 0.35, 2.5, -2.5, 1.005, 2.675, 1e15 + 0.5]
    for n in (0, 1, 2, 3):
        got = [r[0] for r in _eval(spark, [(float(x),) for x in xs], "x double", round_even(F.col("x"), n))]
        assert got == [float(np.round(x, n)) for x in xs]


def test_round_sql_is_half_away_from_zero_on_decimal_text(spark):
    xs = [1.005, 2.675, -1.005, 0.125, -0.125, 12.345, 1234.5678]
    got = [r[0] for r in _eval(spark, [(x,) for x in xs], "x double", round_sql(F.col("x"), 2))]
    assert got == [1.01, 2.68, -1.01, 0.13, -0.13, 12.35, 1234.57]


def test_ieee_ratio_follows_float_division(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)]
    got = [r[0] for r in _eval(spark, rows, "n double, d double", ieee_ratio(F.col("n"), F.col("d")))]
    assert got[0] == float("inf") and got[1] == float("-inf") and np.isnan(got[2])
    assert got[3] is None and got[4] is None and got[5] == 1.5


def test_thresholds_are_exact_where_doubles_overshoot(spark):
    # 0.27 / 0.09 * 100 is exactly 300, but 300.00000000000006 in double arithmetic
    assert (0.27 / 0.09) * 100 > 300
    rows = [(Decimal("0.27"), Decimal("0.09")), (Decimal("0.28"), Decimal("0.09")), (Decimal("1"), Decimal("0"))]
    got = [r[0] for r in _eval(spark, rows, "c decimal(10,2), p decimal(10,2)", ratio_exceeds(F.col("c"), F.col("p"), 300))]
    assert got == [False, True, None]
    alert = [r[0] for r in _eval(spark, rows[:2], "c decimal(10,2), p decimal(10,2)", L.agent_alert(F.col("p"), F.col("c")))]
    assert alert == [L.AGENT_ALERT_HIGH, L.AGENT_ALERT_SEVERE]


def test_combined_verdict_boundary(spark):
    # claims 75 on premiums 100: 75 % + 25 % = exactly 100 -> not a loss
    rows = [(Decimal("75"), Decimal("100")), (Decimal("75.01"), Decimal("100")), (None, Decimal("100"))]
    got = [r[0] for r in _eval(spark, rows, "c decimal(10,2), p decimal(10,2)",
                               L.combined_verdict(F.col("c"), F.col("p"), 25.0))]
    assert got == [L.VERDICT_PROFIT, L.VERDICT_LOSS, L.VERDICT_PROFIT]
