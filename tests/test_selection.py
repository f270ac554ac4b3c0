"""Exact distributed order statistics vs brute force."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lossgrid.operators import selection as sel


def _frame(spark, values, partitions=3):
    return spark.createDataFrame([(v,) for v in values], "v decimal(12,2)").repartition(partitions)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-10**6, max_value=10**6), min_size=1, max_size=60))
def test_order_statistics_match_sorting(spark, cents):
    values = [Decimal(c).scaleb(-2) for c in cents]
    df = _frame(spark, values)
    ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
    got = sel.order_statistics(df, "v", ranks, buckets=4)
    ordered = sorted(values)
    assert got == {r: ordered[r] for r in ranks}


def test_order_statistics_survive_a_hot_value(spark, monkeypatch):
    # one value holds a third of all rows; force histogram rounds (no small-interval fetch)
    rng = np.random.default_rng(7)
    vals = list(rng.integers(-50_000, 50_000, size=2000)) + [1234] * 1000
    values = [Decimal(int(v)).scaleb(-2) for v in vals]
    df = _frame(spark, values, partitions=5)
    ordered = sorted(values)
    ranks = [0, 17, 1500, 2100, 2999]
    assert sel.order_statistics(df, "v", ranks, buckets=16) == {r: ordered[r] for r in ranks}


def test_top_sum_expression_is_tie_safe(spark):
    values = [Decimal(x) for x in (5, 5, 5, 3, 1, 9, 9)]
    df = _frame(spark, values)
    for n in range(0, len(values) + 1):
        for largest in (True, False):
            ordered = sorted(values, reverse=largest)
            if n:
                rank = len(values) - n if largest else n - 1
                t = sel.order_statistics(df, "v", [rank])[rank]
            else:
                t = None
            got = df.agg(sel.top_sum_expr(F.col("v"), n, t, largest).alias("s")).first()["s"]
            assert Decimal(got) == sum(ordered[:n], Decimal(0))


def test_linear_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    cents = rng.integers(0, 10**6, size=501)
    values = [Decimal(int(c)).scaleb(-2) for c in cents]
    df = _frame(spark, values)
    probs = [0.25, 0.5, 0.75]
    order = sel.order_statistics(df, "v", sel.quantile_ranks(len(values), probs))
    got = [sel.linear_quantile(order, len(values), p) for p in probs]
    want = np.percentile(np.array([float(v) for v in values]), [25, 50, 75])
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_values_beyond_double_precision(spark, monkeypatch):
    # neighbours 0.01 apart around 10^20 collapse to one double; the search must stay exact
    base = Decimal("100000000000000000000.00")
    values = [base + Decimal(k).scaleb(-2) for k in (5, 1, 9, 3, 3, 7, 0, 2)]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(38,2)").repartition(3)
    ordered = sorted(values)
    ranks = list(range(len(values)))
    assert sel.order_statistics(df, "v", ranks, buckets=4) == {r: ordered[r] for r in ranks}


def _staged_check(spark, values, ranks, **settings):
    df = spark.createDataFrame([(v,) for v in values], "v decimal(12,2)").repartition(4)
    staged = sel.stage_values(df, "v", "stage-test")
    kept = sorted(v for v in values if v is not None)
    assert (staged.rows, staged.count) == (len(values), len(kept))
    cells, found = sel.rank_cells(staged, ranks, **settings)
    assert found == {r: kept[r] for r in ranks}
    return staged, cells, kept


def test_staged_ranks_and_sums_match_sorting(spark):
    rng = np.random.default_rng(11)
    values = [Decimal(int(c)).scaleb(-2) for c in rng.integers(-10**6, 10**6, size=20_000)] + [Decimal("12.34")] * 10_000 + [None] * 500
    n = 30_000
    _, cells, kept = _staged_check(spark, values, [0, 7_499, 15_000, 27_000, n - 1], cuts=(0.0,))
    assert cells.count() < n / 5  # the gaps are added up
    for size, largest, rank in ((3_000, True, n - 3_000), (3_000, False, 2_999)):
        # thresholds at ranks of their own
        staged, cells, _ = _staged_check(spark, values, [rank], cuts=(0.0,))
        got = cells.agg(sel.top_sum_of_cells(size, kept[rank], largest).alias("s")).first()["s"]
        assert got == sum(sorted(kept, reverse=largest)[:size])
    positive = cells.agg(F.sum(F.when(F.col("lo") > 0, F.col("n")))).first()[0]
    assert positive == sum(v > 0 for v in kept)


def test_the_staged_column_is_scanned_once_after_it_is_written(spark, monkeypatch):
    """Ranks, sums and the described result need no more than the cells."""
    values = [Decimal(k).scaleb(-2) for k in range(5_000)]
    staged = sel.stage_values(spark.createDataFrame([(v,) for v in values], "v decimal(12,2)"), "v", "gone")
    real = sel._cells
    calls = []
    monkeypatch.setattr(sel, "_cells", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(sel, "order_statistics", _only_cells(sel.order_statistics, staged))
    cells, found = sel.rank_cells(staged, [10, 2_500, 4_999])
    assert calls == [1] and found == {r: values[r] for r in (10, 2_500, 4_999)}


def _only_cells(real, staged):
    def run(frame, *args, **kwargs):
        assert frame is not staged.values, "the whole column is searched"
        return real(frame, *args, **kwargs)

    return run


def test_a_rank_outside_its_bracket_is_still_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = [Decimal(int(c)).scaleb(-2) for c in rng.integers(0, 10**6, size=3_000)]
    monkeypatch.setattr(sel, "_brackets", lambda staged, ranks, half: [(-2.0, -1.0)] * len(ranks))
    _, cells, kept = _staged_check(spark, values, [3, 1_500, 2_400])
    got = cells.agg(sel.top_sum_of_cells(600, kept[2_400]).alias("s")).first()["s"]
    assert got == sum(sorted(kept, reverse=True)[:600])


def test_stage_nothing_and_one_value(spark):
    staged, cells, _ = _staged_check(spark, [None, None], [])
    assert staged.sketch is None and cells.count() == 0
    _staged_check(spark, [], [])
    _staged_check(spark, [Decimal("1.00")] * 50, [0, 25, 49])
