"""Exact order statistics without a global sort (AG-14, AG-20, SL-5).

``orderBy(v).limit(n)`` with ``n`` a fraction of the rows (the top 20 % of
clients), or the exact ``percentile`` aggregate over a whole fact column,
both funnel an unbounded number of rows through one task.  Here a value
column is scanned at most twice, at any size:

1. :func:`stage_values` writes it once and, while it is written, observes
   its count, least and largest value and a mergeable quantile sketch (KLL).
2. The sketch brackets every wanted rank in a narrow interval.
   :func:`rank_cells` then scans the staged column once: values inside a
   bracket are counted one by one, those between brackets are only added up
   (one group for each gap).  This much smaller cell table answers the rest:
   the exact value of every rank and the exact sums of the largest and
   smallest values.

A rank that its bracket missed (the sketch errs with a small probability) is
found on the whole staged column instead, so results are exact either way.

Ranks among counted values are found by *histogram refinement*
(:func:`order_statistics`): each round counts the values of the current search
interval in ``B`` equal-width buckets with an ordinary partial/final
aggregation and keeps only the bucket holding rank k.  The driver only ever
receives ``B`` rows per search and round.  Bucket boundaries are a monotone
function of the value, so the first value of an interval lands in bucket 0
and the last in bucket B-1 and every round strictly narrows the interval.  A
hot value holding a third of all rows simply ends up alone in its bucket.

Once the threshold value ``t`` of a top-n selection is known, the sum of
the n largest values is ``sum(v > t) + (n - count(v > t)) * t`` — exact
and tie-safe.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, materialize_observed

DEFAULT_BUCKETS = 1024


@dataclass
class _Search:
    rank: int          # 0-based rank among the ascending values
    lo: object
    hi: object
    below: int         # number of values < lo
    value: object = None
    done: bool = False


def _bucket(v: Column, lo, hi, buckets: int) -> Column:
    """Bucket 0 .. buckets-1 of ``v`` in ``[lo, hi]``: monotone, lo -> 0, hi -> last."""
    lo_d, hi_d = float(lo), float(hi)
    if hi_d > lo_d:
        raw = F.floor((v.cast("double") - F.lit(lo_d)) / F.lit(hi_d - lo_d) * F.lit(float(buckets)))
    else:
        # The ends differ only beyond double precision: bucket on exact decimals.
        raw = F.floor((v - F.lit(lo)) * F.lit(buckets) / (F.lit(hi) - F.lit(lo)))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(buckets - 1)).cast("int")


def order_statistics(values: DataFrame, col: str, ranks: list[int], *,
                     count: int | None = None, vmin=None, vmax=None,
                     buckets: int = DEFAULT_BUCKETS, weight: str | None = None) -> dict[int, object]:
    """Exact k-th smallest non-null values of ``values[col]`` for each 0-based rank.

    ``values`` should be materialised (it is scanned once per round).  With
    ``weight`` a row stands for that many equal values.
    """
    v = F.col(col)
    times = F.col(weight) if weight else F.lit(1)
    data = values.select(v, *([times] if weight else [])).filter(v.isNotNull())
    if count is None or vmin is None or vmax is None:
        row = data.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        count, vmin, vmax = row["n"], row["lo"], row["hi"]
    out: dict[int, object] = {}
    searches = []
    for r in sorted(set(ranks)):
        if not 0 <= r < count:
            raise ValueError(f"rank {r} outside 0..{count - 1}")
        searches.append(_Search(rank=r, lo=vmin, hi=vmax, below=0))
    while True:
        for s in searches:
            if not s.done and s.lo == s.hi:
                s.value, s.done = s.lo, True
        active = [s for s in searches if not s.done]
        if not active:
            break
        tags = [
            F.when(
                (v >= F.lit(s.lo)) & (v <= F.lit(s.hi)),
                F.struct(F.lit(i).alias("sid"), _bucket(v, s.lo, s.hi, buckets).alias("b")),
            )
            for i, s in enumerate(active)
        ]
        # Only rows inside an interval are tagged, once for each search.
        inside = reduce(or_, [(v >= F.lit(s.lo)) & (v <= F.lit(s.hi)) for s in active])
        hist = (
            data.filter(inside)
            .select(v, times.alias("_times"), F.explode(F.array(*tags)).alias("t"))
            .filter(F.col("t").isNotNull())
            .groupBy(F.col("t.sid").alias("sid"), F.col("t.b").alias("b"))
            .agg(F.sum("_times").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
            .collect()
        )
        per_search: dict[int, list] = {}
        for row in hist:
            per_search.setdefault(row["sid"], []).append(row)
        for i, s in enumerate(active):
            seen = s.below
            for row in sorted(per_search.get(i, []), key=lambda r: r["b"]):
                if seen + row["n"] > s.rank:
                    s.lo, s.hi, s.below = row["lo"], row["hi"], seen
                    break
                seen += row["n"]
            else:  # pragma: no cover - counts always cover the rank
                raise RuntimeError("rank not found in histogram")
    for s in searches:
        out[s.rank] = s.value
    return out


def top_sum_expr(v: Column, n: int, threshold, largest: bool = True) -> Column:
    """Sum of the n largest (or smallest) values given the n-th value ``threshold``."""
    if n == 0 or threshold is None:
        return F.lit(0).cast("decimal(38,2)")
    t = F.lit(threshold)
    beyond = v > t if largest else v < t
    strict_sum = F.coalesce(F.sum(F.when(beyond, v)), F.lit(0))
    strict_cnt = F.count_if(beyond)
    return strict_sum + (F.lit(n) - strict_cnt) * t


#: Size of the sketch; its rank error is under 0.0045 of all rows (99 %).
SKETCH_K = 1024
#: Half the width of a bracket, as a share of all rows.
BRACKET = 0.009


@dataclass(frozen=True)
class StagedValues:
    """A written value column ``v`` and what was observed while it was written."""

    values: DataFrame
    name: str
    rows: int          # with NULLs
    count: int         # without
    lo: object
    hi: object
    sketch: bytes | None
    extra: dict[str, object]

    def quantiles(self, shares: list[float]) -> list[float]:
        """Approximate quantiles from the sketch (no scan)."""
        found = self.values.sparkSession.range(1).select(
            F.kll_sketch_get_quantile_double(F.lit(self.sketch), F.array(*[F.lit(float(s)) for s in shares]))
        )
        return list(found.first()[0])


def stage_values(df: DataFrame, col: str, name: str, **extra: Column) -> StagedValues:
    """Write ``df[col]`` once, observing count, range, quantile sketch and the ``extra`` aggregates of ``v``."""
    v = F.col("v")
    kept, seen = materialize_observed(
        df.select(F.col(col).alias("v")), name, rows=F.count(F.lit(1)), count=F.count(v), lo=F.min(v), hi=F.max(v),
        sketch=F.kll_sketch_agg_double(v.cast("double"), F.lit(SKETCH_K)), **extra,
    )
    sketch = bytes(seen["sketch"]) if seen["count"] else None
    return StagedValues(kept, name, seen["rows"], seen["count"], seen["lo"], seen["hi"], sketch, {k: seen[k] for k in extra})


def _brackets(staged: StagedValues, ranks: list[int], half: float) -> list[tuple[float, float]]:
    """Intervals (as doubles) that hold the ranks with high probability."""
    n = staged.count
    shares = [(max(r / n - half, 0.0), min((r + 1) / n + half, 1.0)) for r in ranks]
    ends = staged.quantiles([x for pair in shares for x in pair]) if shares else []
    lo, hi = float(staged.lo), float(staged.hi)
    out = []
    for (a, b), p, q in zip(shares, ends[::2], ends[1::2]):
        out.append((lo if a == 0.0 else p, hi if b == 1.0 else q))
    return out


def _cells(staged: StagedValues, brackets: list[tuple[float, float]]) -> DataFrame:
    """``zone, v, n, s, lo, hi``: one row for each value inside a bracket, one for each gap between them."""
    merged: list[list[float]] = []
    for a, b in sorted(brackets):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    v, x = F.col("v"), F.col("v").cast("double")
    # 0, 2, 4 ... are the gaps, 1, 3, 5 ... the brackets.
    zone = reduce(add, [(x >= F.lit(a)).cast("int") + (x > F.lit(b)).cast("int") for a, b in merged], F.lit(0))
    rows = staged.values.where(v.isNotNull()).select(v, zone.alias("zone"))
    key = F.when(F.col("zone") % 2 == 1, v)
    counted = rows.groupBy("zone", key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    return materialize(counted.select("zone", F.col("key").alias("v"), "n", "s", "lo", "hi"), f"{staged.name}-cells")


def rank_cells(staged: StagedValues, ranks: list[int], cuts: tuple[float, ...] = (), half: float = BRACKET) -> tuple[DataFrame, dict[int, object]]:
    """The cell table and the exact value of every 0-based rank among the non-null values.

    Every value in ``cuts`` and every returned value lies in a cell of its own
    or in a gap wholly on one side of it, so counts and sums beyond it are
    exact sums of cells.
    """
    ranks = sorted(set(ranks))
    points = [(float(c), float(c)) for c in cuts]
    cells = _cells(staged, points + (_brackets(staged, ranks, half) if staged.count else []))
    if not ranks:
        return cells, {}
    sizes = {r["zone"]: r["n"] for r in cells.groupBy("zone").agg(F.sum("n").alias("n")).collect()}
    inner, missed = {}, []
    for rank in ranks:
        below = gaps = 0
        for zone in sorted(sizes):
            if below + sizes[zone] > rank:
                break
            below += sizes[zone]
            gaps += sizes[zone] * (zone % 2 == 0)
        if zone % 2:
            inner[rank] = rank - gaps
        else:
            missed.append(rank)
    found: dict[int, object] = {}
    if inner:
        places = order_statistics(cells.where("v is not null"), "v", list(inner.values()), weight="n")
        found |= {rank: places[at] for rank, at in inner.items()}
    if missed:
        found |= order_statistics(staged.values, "v", missed, count=staged.count, vmin=staged.lo, vmax=staged.hi)
        cells = _cells(staged, points + [(float(x), float(x)) for x in found.values()])
    return cells, found


def top_sum_of_cells(n: int, threshold, largest: bool = True) -> Column:
    """:func:`top_sum_expr` as an aggregate over the cell table."""
    if n == 0 or threshold is None:
        return F.lit(0).cast("decimal(38,2)")
    t = F.lit(threshold)
    beyond = F.col("lo") > t if largest else F.col("hi") < t
    strict_sum = F.coalesce(F.sum(F.when(beyond, F.col("s"))), F.lit(0))
    strict_cnt = F.coalesce(F.sum(F.when(beyond, F.col("n"))), F.lit(0))
    return strict_sum + (F.lit(n) - strict_cnt) * t


def fraction_size(n_rows: int, fraction: float) -> int:
    """pandas-style ``int(N * f)`` (truncation of the float product)."""
    return int(n_rows * fraction)


def linear_quantile(order_stat: dict[int, object], count: int, p: float) -> float:
    """Quantile with linear interpolation between neighbouring order statistics."""
    h = (count - 1) * p
    lo_rank = math.floor(h)
    hi_rank = min(lo_rank + 1, count - 1)
    lo = float(order_stat[lo_rank])
    hi = float(order_stat[hi_rank])
    return lo + (hi - lo) * (h - lo_rank)


def quantile_ranks(count: int, probs: list[float]) -> list[int]:
    ranks = []
    for p in probs:
        h = (count - 1) * p
        lo_rank = math.floor(h)
        ranks += [lo_rank, min(lo_rank + 1, count - 1)]
    return ranks
