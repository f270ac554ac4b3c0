"""Invariants over the mapped test tables (SURVEY §5 (3) and (5))."""

from __future__ import annotations

import pytest

from lossgrid.plans import charts, master_track as n
from lossgrid.sources.testmap import mapped_portfolio
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def t(spark):
    return mapped_portfolio(spark, SF_SMALL)


def _sum(df, col):
    return round(sum(r[col] for r in df.collect()), 2)


def test_master_has_one_row_per_policy(t):
    assert n.n09_master(t).count() == t.policies.count()


def test_rollups_add_up_to_the_portfolio(t):
    g = n.n10_global_kpis(t).first()
    for df, col in ((n.n11_product(t), "primes"), (n.n12_country(t), "primes"), (n.n14_yearly(t), "primes")):
        assert _sum(df, col) == round(g["ca_total"], 2)
    assert _sum(n.n11_product(t), "profit") == round(g["profit_net"], 2)
    assert _sum(n.n06_premiums_agg(t), "total_premium") == round(g["ca_total"], 2)


def test_shares_and_segments(t):
    assert abs(_sum(n.n12_country(t), "part_ca_pct") - 100) < 0.5
    seg = n.n18_clv_segments(t)
    assert sum(r["nb"] for r in seg.collect()) == n.n17_client_clv(t).count()
    assert abs(_sum(seg, "part_pct") - 100) < 0.5


def test_treemap_levels_are_consistent(t):
    rows = charts.v08_portfolio_treemap(t).collect()
    root = [r for r in rows if r["level"] == 2]
    leaves = [r for r in rows if r["level"] == 0]
    assert len(root) == 1 and root[0]["nb"] == sum(r["nb"] for r in leaves)


def test_histogram_counts_every_priced_contract(t):
    h = charts.v07_lr_histogram(t)
    summary = charts.v07b_lr_summary(t).first()
    assert sum(r["n"] for r in h.collect()) == summary["n_contrats"]
    assert summary["n_rentables"] + summary["n_deficitaires"] == summary["n_contrats"]


@pytest.mark.parametrize("name", ["s02_product_profitability", "n17_client_clv", "s07_cohort_retention"])
def test_results_do_not_depend_on_partitioning(spark, t, name):
    from lossgrid.plans.registry import QUERIES

    before = sorted(map(tuple, QUERIES[name](t).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        after = sorted(map(tuple, QUERIES[name](t).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert before == after


def test_report_over_shared_master_equals_independent_queries(spark, t):
    from lossgrid.plans.registry import QUERIES
    from lossgrid.plans.report import build_report
    from lossgrid.plans.sql_track import AS_OF

    report = build_report(t, as_of=AS_OF)
    assert set(report) == set(QUERIES)
    names = ["n11_product", "n22_agent_performance", "v08_portfolio_treemap", "n19_clv_concentration"]
    names += [n for n in QUERIES if n.startswith("s")]
    for name in names:
        got = sorted(repr(tuple(r)) for r in report[name].collect())
        assert got == sorted(repr(tuple(r)) for r in QUERIES[name](t).collect()), name
