"""Physical-plan properties that matter at scale."""

from __future__ import annotations

import re

import pytest

from lossgrid.plans.registry import QUERIES
from lossgrid.session import materialize, release
from lossgrid.sources.testmap import mapped_portfolio
from tests.conftest import SF_SMALL

LAZY = sorted(QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return mapped_portfolio(spark, SF_SMALL)


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_product_or_python_udf(t, name):
    plan = _plan(QUERIES[name](t))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_scans_are_pruned_and_filtered(t):
    plan = t.premiums.groupBy("policy_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)" in plan
    assert "l_returnflag" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_null_counts_shuffle_no_rows(spark, portfolio):
    lines = _static_plan(spark, lambda: QUERIES["n01b_null_columns"](portfolio()))
    exchanges = [x for x in lines if "Exchange" in x]
    assert exchanges and all("SinglePartition" in x for x in exchanges)


def test_materialised_tables_are_pruned_and_released(spark, t):
    kept = materialize(t.policies, "plan-test")
    assert kept.schema.fieldNames() == t.policies.schema.fieldNames()
    assert "ReadSchema: struct<policy_id:bigint>" in _plan(kept.select("policy_id"))
    assert release(spark, "plan-test") == 1 and release(spark, "plan-test") == 0


def test_sql_track_never_joins_premium_rows_to_claim_rows(t):
    # the fan-out is computed from per-policy aggregates: every join input is aggregated
    plan = QUERIES["s02_product_profitability"](t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 4


def _static_plan(spark, build) -> list[str]:
    """Lines of the plan without broadcast joins and without adaptive execution."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _plan(build()).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _dealt(lines: list[str], key: str) -> list[str]:
    """The operator below every exchange on ``key``."""
    return [lines[i + 1] for i, x in enumerate(lines[:-1]) if re.search(rf"Exchange hashpartitioning\(.*{key}#", x)]


BY_CLIENT = ("n17_client_clv", "n18_clv_segments", "n20_top10_clients", "n21_bottom10_clients", "s05_top_clients_clv")
BY_AGENT = ("n22_agent_performance", "n23_top10_agents", "n24_bottom10_agents", "n25_agents_claims_without_premium",
            "n25b_agent_lookup", "n26_experience_profit_corr", "v05_agent_scatter", "v06_top_bottom_agents",
            "s04_top_agents", "s08_underperforming_agents")


@pytest.mark.parametrize("name,key", [(n, "client_id") for n in BY_CLIENT] + [(n, "agent_id") for n in BY_AGENT])
def test_rollups_combine_a_hot_key_before_it_is_dealt_out(spark, t, name, key):
    below = _dealt(_static_plan(spark, lambda: QUERIES[name](t)), key)
    # an exchange on the key carries partial sums, or the rows of the dimension
    for line in below:
        assert "HashAggregate" in line or not re.search("Join|policy_id", line), line


@pytest.mark.parametrize("name", ["n10_global_kpis", "n11_product", "n14_yearly", "n15_risk_by_product", "v01_gauge",
                                  "v02_profit_by_product", "v04_trend", "v07_lr_histogram", "v07b_lr_summary"])
def test_unread_dimensions_are_not_joined(spark, t, name):
    lines = _static_plan(spark, lambda: QUERIES[name](t))
    below = _dealt(lines, "agent_id") + ([] if name.startswith("n10") else _dealt(lines, "client_id"))
    assert below == []


@pytest.mark.parametrize("name", ["n12_country", "n13_country_product_mean_lr", "n13b_country_product_pivot", "v03_country_bands", "v08_portfolio_treemap"])
def test_country_results_do_not_join_agents(spark, t, name):
    assert _dealt(_static_plan(spark, lambda: QUERIES[name](t)), "agent_id") == []


STAGED = {"n13b_country_product_pivot", "n16_claim_amount_describe", "n19_clv_concentration", "v07_lr_histogram"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STAGED))
def test_building_a_query_starts_no_job(spark, portfolio, name):
    sc = spark.sparkContext
    for label, tables in (("mapped", mapped_portfolio(spark, SF_SMALL)), ("unknown keys", portfolio())):
        group = f"build-{name}-{label}"
        sc.setJobGroup(group, group)
        try:
            QUERIES[name](tables)
            assert list(sc.statusTracker().getJobIdsForGroup(group)) == []
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)


def test_repeated_dimension_keys_are_found_by_the_plan(spark, portfolio):
    clients = [(1, 30, "Kenya", None), (1, 31, "Maroc", None), (2, 40, "Kenya", None), (None, 1, "Kenya", None), (None, 2, "Kenya", None)]
    policies = [(10, 1, "Auto", None, None, 5), (11, 2, "Auto", None, None, 5), (12, None, "Auto", None, None, 6), (13, 9, "Vie", None, None, None)]
    agents = [(5, "Kenya", 3), (5, "Kenya", 3), (5, "Kenya", 4)]
    t = portfolio(clients=clients, policies=policies, agents=agents)
    from lossgrid.operators.master import policy_facts, verified, with_copies

    assert sorted(r["policy_id"] for r in with_copies(t.policies, t, "clients").collect()) == [10, 10, 11, 12, 12, 13]
    assert sorted(r["policy_id"] for r in policy_facts(t, need=()).collect()) == [10] * 6 + [11] * 3 + [12] * 2 + [13]
    whole = policy_facts(t).count()
    assert whole == policy_facts(t, need=()).count() == policy_facts(t, need=("clients",)).count()
    assert verified(t).unique == frozenset()
    assert verified(portfolio(clients=clients[2:4], policies=policies)).unique == {"clients", "agents"}
