"""Whitening against plain linear algebra and exact sums, and on edge rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from lossgrid.llm import queries
from lossgrid.llm import whitening as wh
from tests.conftest import SF_SMALL


def check(rows: list[tuple], found: list, components: int = wh.COMPONENTS) -> None:
    """``rows`` (id, vector) that are usable against the returned rows."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(rows), x.sum(axis=0)
    v = np.array([[float(sum((n * a - s) * (n * b - t) for a, b in zip(x[:, i], x[:, j], strict=True))) / n**3 for j, t in enumerate(sums)] for i, s in enumerate(sums)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == n * count
    centred = (x.astype(float) - (sums / n).astype(float))
    by = {}
    for r in found:
        by.setdefault((r[0], r.component), []).append(r)
    gaps = np.array([min(abs(values[k] - values[j]) for j in range(len(values)) if j != k) / values[0] if len(values) > 1 else 1 for k in range(count)])
    for k in range(count):
        w = centred @ vectors[:, k] / math.sqrt(values[k])
        got = np.array([by[i, k + 1][0].whitened for i, _ in rows])
        if gaps[k] > 1e-6 and len({i for i, _ in rows}) == n:
            assert min(np.abs(got - w).max(), np.abs(got + w).max()) < 1e-6
    for (i, _), own in zip(rows, x, strict=True):
        for r in by[i, 1]:
            assert r.n == n and r.identity_error < 1e-9
        assert any(r.deviation == sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True)) for r in by[i, 1])
    for r in found:
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-9 * r.explained


@pytest.mark.parametrize("dim,rank", [(1, 1), (2, 2), (7, 7), (12, 5), (33, 33), (40, 40)])
def test_factor_and_rotations(dim, rank):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(dim, rank)) * np.logspace(0, -5, rank)
    v = a @ a.T
    factor = wh.pivoted_cholesky(v)
    assert np.abs(factor @ factor.T - v).max() <= 1e-14 * np.abs(v).max()
    norms, columns = wh.one_sided_jacobi(factor)
    assert (np.diff(norms) <= 0).all()
    assert np.abs(columns[:, :rank].T @ columns[:, :rank] - np.eye(rank)).max() < 1e-12
    exact = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.abs(norms[:rank] - exact).max() <= 1e-13 * exact[0]
    small = exact > 1e-10 * exact[0]  # those that v itself still holds
    assert (np.abs(norms[:rank] - exact) <= 1e-5 * exact)[small].all()


def test_factor_of_nothing():
    assert wh.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
    norms, columns = wh.one_sided_jacobi(np.zeros((3, 0)))
    assert norms.shape == (0,) and columns.shape == (3, 0)


def test_query_on_its_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_SMALL}/embeddings.parquet'").fetchall()
    check(rows, queries.QUERIES["op12_whitening"](spark, SF_SMALL).collect())


def test_unusable_vectors_extra_columns_and_repeats(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 2.0, 3.0, 4.0]), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, [])]
    schema = "vec_id long, embedding array<float>, component string, n string, vector int, whitened array<int>, cell int"
    frame = spark.createDataFrame([(*r, "c", "n", 1, [1], 2) for r in good + bad], schema)
    single = [(i, [float(np.float32(c)) for c in v]) for i, v in good]
    check(single, wh.whiten(frame).collect())
    check(single, wh.whiten(frame, components=2).collect(), 2)
    twice = wh.whiten(frame.union(frame).repartition(5)).collect()
    assert len(twice) == 2 * 30 * 5 and set(Counter((r.vec_id, r.component) for r in twice).values()) == {2}
    assert {r.n for r in twice} == {60}


def test_without_variance_rank_and_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).count() == 0
    line = [(i, [i / 8, i / 4, 3.0]) for i in range(10)] + [(None, [0.5, 1.0, 3.0])]
    found = wh.whiten(spark.createDataFrame(line, schema)).collect()
    assert len(found) == 11 and {r.component for r in found} == {1} and {round(r.explained, 9) for r in found} == {1.0}


def test_far_entries_do_not_break_it(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    found = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and any(r.deviation is None for r in found)
