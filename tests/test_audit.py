"""Repeated rows by fingerprints: exact on NULLs, collisions and hot rows, and no whole row in a shuffle."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossgrid.operators import flags, quality
from lossgrid.sources.testmap import mapped_portfolio
from tests.conftest import SF_SMALL


def _dups(spark, rows, schema):
    found = quality.audit(spark.createDataFrame(rows, schema).repartition(3), "t").collect()
    return found[0]["n_rows"], found[0]["n_dup_rows"], [r["n_nulls"] for r in found]


def test_nulls_are_equal_and_keep_their_place(spark):
    rows = [("a", None), (None, "a"), ("a", None), (None, None), (None, None), (None, None), ("a", "a"), ("", None)]
    assert _dups(spark, rows, "x string, y string") == (8, 3, [4, 6])
    assert _dups(spark, [], "x string, y string") == (0, 0, [0, 0])


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_flags_that_collide_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "flag_words", lambda h, c: flags.flag_words(h, c, bits))
    monkeypatch.setattr(quality, "with_flag", lambda r, v, w: flags.with_flag(r, v, w, bits))
    rng = np.random.default_rng(bits % 97)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 60, size=(900, 2))] + [(7, 7)] * 450  # a third is one row
    extra = sum(n - 1 for n in Counter(rows).values())
    assert _dups(spark, rows, "x int, y int") == (1350, extra, [0, 0])


def test_flag_words_are_bounded_and_hold_every_hash(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    words = flags.flag_words(hashes, "h", 256)
    assert words.count() <= 4
    assert flags.with_flag(hashes, F.col("h"), flags.flag_words(hashes, "h")).where("not _flagged").count() == 0
    few = flags.flag_words(hashes.limit(3), "h")
    assert flags.with_flag(hashes, F.col("h"), few).where("_flagged").count() < 20


def test_many_columns(spark):
    names = [f"c{i}" for i in range(130)]
    rows = [tuple(None if (i + j) % 3 == 0 else j for j in range(130)) for i in range(6)]
    found = quality.audit(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), "wide").collect()
    assert {r["n_dup_rows"] for r in found} == {3}
    assert [r["n_nulls"] for r in found] == [sum(r[j] is None for r in rows) for j in range(130)]


@pytest.mark.parametrize("table", ["claims", "premiums", "policies"])
def test_no_exchange_carries_whole_rows(spark, table):
    """Rows are dealt out only after the flags have taken out those without a twin."""
    t = mapped_portfolio(spark, SF_SMALL)
    df = getattr(t, table)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = quality.audit(df, table)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    seen = 0
    for i, line in enumerate(plan):
        if re.search(r"(?<!Reused)Exchange hashpartitioning\(", line) and "_h1" not in line and "_groupingexpression" not in line:
            below = "\n".join(plan[i : i + 9])
            assert "_flagged" in below or "BroadcastHashJoin" in below, below
            seen += 1
    assert seen == 1
    assert any("ReusedExchange" in x and "_h1" in x for x in plan)  # the fingerprints are made once
    assert not any("ObjectHashAggregate" in x or "SortAggregate" in x for x in plan)
