from __future__ import annotations

import re
import tempfile

from lossgrid.operators.master import policy_facts
from lossgrid.plans.registry import QUERIES
from lossgrid.sources.bucketed import load_bucketed, save_bucketed
from lossgrid.sources.readers import Portfolio
from lossgrid.sources.testmap import mapped_portfolio
from tests.conftest import SF_SMALL


def _policy_exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning\(policy_id", plan))


def test_bucketed_facts_need_no_policy_exchange(spark):
    location = tempfile.mkdtemp(prefix="lossgrid-db-")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS lossgrid_test LOCATION '{location}'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = mapped_portfolio(spark, SF_SMALL)
        save_bucketed(t, 4, database="lossgrid_test")
        b = load_bucketed(spark, database="lossgrid_test")
        assert _policy_exchanges(policy_facts(t)) == 3
        assert _policy_exchanges(policy_facts(b)) == 0
        # The check of the keys is stored with the tables.
        assert b.unique == {"clients", "agents"}
        twice = Portfolio(**{**t.tables(), "clients": t.clients.union(t.clients.limit(1))})
        save_bucketed(twice, 2, database="lossgrid_test", prefix="twice_")
        assert load_bucketed(spark, database="lossgrid_test", prefix="twice_").unique == {"agents"}
        for name in ("n11_product", "n17_client_clv", "s02_product_profitability", "s08_underperforming_agents"):
            assert sorted(map(tuple, QUERIES[name](b).collect())) == sorted(map(tuple, QUERIES[name](t).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
