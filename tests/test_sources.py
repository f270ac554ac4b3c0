from __future__ import annotations

import os
import re
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lossgrid.operators.master import MASTER_COLUMNS
from lossgrid.plans import charts
from lossgrid.plans import master_track as n
from lossgrid.plans.registry import QUERIES
from lossgrid.plans.report import write_report
from lossgrid.sources.readers import read_csv_portfolio, read_csv_table, read_parquet_portfolio, rejected_counts
from lossgrid.sources.schemas import SCHEMAS
from lossgrid.sources.sinks import read_master, read_master_csv, replace_folder, stored_facts, write_chart_datasets, write_master_csv, write_master_parquet
from lossgrid.sources.testmap import mapped_portfolio
from tests.conftest import SF_SMALL


def _scratch():
    return tempfile.mkdtemp(prefix="lossgrid-test-")


def test_f16_csv_round_trip_keeps_typographic_apostrophe(spark):
    folder = _scratch()
    with open(f"{folder}/agents.csv", "w", encoding="utf-8", newline="") as fh:
        fh.write("agent_id,region,experience_years\r\n1,Sénégal,6\r\n3,Côte d’Ivoire,10\r\n")
    agents = read_csv_table(spark, f"{folder}/agents.csv", "agents")
    got = {r["agent_id"]: r["region"] for r in agents.collect()}
    assert got == {1: "Sénégal", 3: "Côte d’Ivoire"}
    assert agents.schema["experience_years"].dataType.simpleString() == "int"
    label = agents.select(F.substring("region", 1, 3).alias("s")).orderBy("s").collect()
    assert [r["s"] for r in label] == ["Côt", "Sén"]


def test_csv_reader_fails_fast_on_bad_date(spark):
    folder = _scratch()
    with open(f"{folder}/clients.csv", "w", encoding="utf-8") as fh:
        fh.write("client_id,age,country,signup_date\n1,30,Kenya,not-a-date\n")
    with pytest.raises(Exception):
        read_csv_table(spark, f"{folder}/clients.csv", "clients").collect()
    lenient = read_csv_table(spark, f"{folder}/clients.csv", "clients", lenient=True).collect()
    assert lenient[0]["signup_date"] is None


def test_rejected_rows_are_listed_with_file_and_text(spark):
    folder = _scratch()
    for name, schema in SCHEMAS.items():
        with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as fh:
            fh.write(",".join(schema.names) + "\n")
            if name == "clients":
                fh.write("1,30,Kenya,not-a-date\n2,x,Côte d’Ivoire,2020-01-02\n3,33,Maroc,2020-01-03\n4,44\n5,,,\n6,1,Kenya,2020-01-01,7\n")
            if name == "claims":
                fh.write("1,1,12.345x,2020-01-01,Accepted\n2,1,10.00,2020-01-01,Accepted\n")
    t = read_csv_portfolio(spark, folder, lenient=True)
    bad = {(r["table_name"], r["file_name"], r["row_text"]): r["null_fields"] for r in t.rejected.collect()}
    assert bad == {
        ("clients", "clients.csv", "1,30,Kenya,not-a-date"): "signup_date",
        ("clients", "clients.csv", "2,x,Côte d’Ivoire,2020-01-02"): "age",
        ("clients", "clients.csv", "4,44"): "country,signup_date",
        ("clients", "clients.csv", "6,1,Kenya,2020-01-01,7"): "",
        ("claims", "claims.csv", "1,1,12.345x,2020-01-01,Accepted"): "claim_amount",
    }
    # Neither the columns read nor a count changes what is rejected; no row is lost.
    assert t.rejected.count() == t.rejected.select("table_name").count() == 5
    assert {r["table_name"]: r["n_rejected"] for r in rejected_counts(t).collect()} == {"clients": 4, "claims": 1}
    assert t.clients.count() == 6 and t.claims.count() == 2
    with pytest.raises(ValueError):
        rejected_counts(mapped_portfolio(spark, SF_SMALL))
    written = write_report(t, f"{folder}/out")
    assert spark.read.parquet(written["rejected_rows"]).count() == 5


def test_a_failed_write_leaves_the_old_export_whole(spark):
    out = f"{_scratch()}/export"
    rows = spark.range(10)
    replace_folder(spark, out, rows.write.parquet)
    fails = spark.range(10).select(F.assert_true(F.col("id") < 7, F.lit("broken")).alias("x"))
    for write in (fails.write.parquet, rows.write.format("no such format").save):
        with pytest.raises(Exception):
            replace_folder(spark, out, write)
        assert spark.read.parquet(out).count() == 10
        assert os.listdir(os.path.dirname(out)) == ["export"]
    replace_folder(spark, out, spark.range(3).write.parquet)
    assert spark.read.parquet(out).count() == 3
    assert os.listdir(os.path.dirname(out)) == ["export"]


def test_an_export_may_be_made_from_the_one_it_replaces(spark):
    out = f"{_scratch()}/export"
    replace_folder(spark, out, spark.range(10).write.parquet)
    replace_folder(spark, out, spark.read.parquet(out).where("id < 4").write.parquet)
    assert spark.read.parquet(out).count() == 4


def test_years_of_the_stored_master_are_pruned(spark):
    t = mapped_portfolio(spark, SF_SMALL)
    out = f"{_scratch()}/master"
    write_master_parquet(n.n09_master(t), out)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    some = read_master(spark, out, [1993, 1995])
    assert re.search(r"PartitionFilters: \[.*annee_debut#\d+ IN \(1993,1995\)", plan(some))
    assert sorted(map(str, some.collect())) == sorted(map(str, n.n09_master(t).where("annee_debut in (1993, 1995)").collect()))
    # Years that only a join knows prune as well.
    spark.range(1990, 2000).select(F.col("id").cast("int").alias("y"), (F.col("id") % 3).alias("k")).write.mode("overwrite").parquet(f"{out}-years")
    years = spark.read.parquet(f"{out}-years").where("k = 1")
    joined = read_master(spark, out).join(F.broadcast(years), F.col("annee_debut") == F.col("y"))
    assert "dynamicpruning" in plan(joined)
    # Every rollup runs over the stored rows and gives the same.
    stored = t.with_facts(stored_facts(spark, out))
    for name in ("n10_global_kpis", "n11_product", "n12_country", "n14_yearly", "n17_client_clv", "n22_agent_performance", "v08_portfolio_treemap"):
        assert sorted(map(str, QUERIES[name](stored).collect())) == sorted(map(str, QUERIES[name](t).collect())), name


def test_the_csv_master_reads_back_as_it_was(spark):
    t = mapped_portfolio(spark, SF_SMALL)
    out = f"{_scratch()}/master"
    write_master_csv(n.n09_master(t), out)
    back = read_master_csv(spark, out)
    assert back.dtypes == n.n09_master(t).dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, n.n09_master(t).collect()))


def test_master_sinks_and_readers_round_trip(spark):
    t = mapped_portfolio(spark, SF_SMALL)
    master = n.n09_master(t)
    out = _scratch()
    write_master_csv(master, f"{out}/master_csv")
    back = spark.read.option("header", True).csv(f"{out}/master_csv")
    assert back.columns == list(MASTER_COLUMNS)
    assert back.count() == master.count()
    write_master_parquet(master, f"{out}/master_pq")
    pq = spark.read.parquet(f"{out}/master_pq")
    assert pq.count() == master.count()
    # a partition filter on the start year is pruned at the scan
    plan = pq.filter(F.col("annee_debut") == 1995)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "annee_debut" in plan


def test_portfolio_csv_and_parquet_readers(spark):
    t = mapped_portfolio(spark, SF_SMALL)
    out = _scratch()
    for name, df in t.tables().items():
        df.write.mode("overwrite").option("header", True).csv(f"{out}/csv/{name}.csv")
        df.write.mode("overwrite").parquet(f"{out}/pq/{name}")
    from_csv = read_csv_portfolio(spark, f"{out}/csv", wide_ids=True)
    from_pq = read_parquet_portfolio(spark, f"{out}/pq", wide_ids=True)
    for name, df in t.tables().items():
        assert [f.dataType for f in getattr(from_csv, name).schema] == [f.dataType for f in df.schema]
        assert getattr(from_csv, name).count() == df.count()
        assert getattr(from_pq, name).exceptAll(df).count() == 0


def test_chart_datasets_written(spark):
    t = mapped_portfolio(spark, SF_SMALL)
    out = _scratch()
    paths = write_chart_datasets(t, out)
    assert len(paths) == 9
    assert spark.read.parquet(paths[0]).count() == 1


def test_charts_read_the_fact_tables_once(spark):
    """Every chart as its query gives it, also with repeated and null keys, from one pass over premiums and claims."""
    t = mapped_portfolio(spark, SF_SMALL)
    few = [t.clients.limit(50), t.clients.limit(1).withColumn("client_id", F.lit(None).cast("bigint"))]
    odd = replace(t, clients=t.clients.union(few[0]).union(few[1]), agents=t.agents.union(t.agents.limit(9)), unique=frozenset())
    for given in (t, odd):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        watched = replace(given, premiums=given.premiums.mapInArrow(counted, given.premiums.schema), claims=given.claims.mapInArrow(counted, given.claims.schema))
        paths = write_chart_datasets(watched, _scratch())
        assert seen.value == given.premiums.count() + given.claims.count()
        for (name, build), path in zip(charts.QUERIES.items(), paths, strict=True):
            assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, build(given).collect())), name


def test_wide_ids_run_the_same_queries(spark):
    folder = _scratch()
    t = mapped_portfolio(spark, SF_SMALL)
    for name, df in t.tables().items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    wide = read_csv_portfolio(spark, folder, wide_ids=True)
    narrow = read_csv_portfolio(spark, folder, wide_ids=False)
    assert wide.policies.schema["policy_id"].dataType.simpleString() == "bigint"
    assert narrow.policies.schema["policy_id"].dataType.simpleString() == "int"
    assert sorted(map(tuple, n.n11_product(narrow).collect())) == sorted(map(tuple, n.n11_product(wide).collect()))
    a = sorted(map(tuple, n.n11_product(wide).collect()))
    b = sorted(map(tuple, n.n11_product(t).collect()))
    assert a == b


def test_write_report_writes_every_result(spark):
    t = mapped_portfolio(spark, SF_SMALL)
    out = _scratch()
    written = write_report(t, out)
    assert set(written) == set(QUERIES)
    assert spark.read.parquet(written["n11_product"]).count() == 4
    assert spark.read.parquet(written["n09_master"]).count() == t.policies.count()


def test_command_line_writes_and_shows(spark, capsys):
    from lossgrid.__main__ import main

    out = _scratch()
    assert main(["--mapped", SF_SMALL, "--query", "s10_combined_ratio", "--out", out, "--format", "csv"]) == 0
    printed = capsys.readouterr().out
    assert "combined_ratio_estime_pct" in printed and "n11_product\t" in printed
    assert spark.read.option("header", True).csv(f"{out}/n11_product").count() == 4
