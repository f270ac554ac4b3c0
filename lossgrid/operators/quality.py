"""Data-quality and profiling operators (DQ-1 .. DQ-12).

:func:`audit` reports rows, duplicate rows and NULLs per column of one
table.  Repeated rows (NULL = NULL, as pandas ``duplicated`` has it) are found
from 128-bit fingerprints: the group-by moves hashes, not rows.  Only the
rows whose fingerprint was met twice are then grouped by all their columns,
which decides exactly; the fingerprints met twice go to the tasks as a
bounded set of flags (:mod:`lossgrid.operators.flags`).  :func:`null_columns`
needs no duplicates and shuffles no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import Portfolio
from .flags import flag_words, with_flag


def _by_column(df: DataFrame):
    """One struct ``c`` for each column of ``df`` from the sums ``__null_0``, ``__null_1``, ..."""
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("column_position"),
                    F.lit(c).alias("column_name"),
                    F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                    F.coalesce(F.col(f"__null_{i}"), F.lit(0)).cast("long").alias("n_nulls"),
                )
                for i, c in enumerate(df.columns)
            ]
        )
    ).alias("c")


def null_columns(df: DataFrame, name: str) -> DataFrame:
    """DQ-4: ``table_name, column_name, n_nulls`` of the columns that hold NULLs.

    One pass with partial sums in every task; no row is shuffled.
    """
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"__null_{i}") for i, c in enumerate(df.columns)])
    long = wide.select(_by_column(df)).where("c.n_nulls > 0")
    return long.select(F.lit(name).alias("table_name"), "c.column_name", "c.n_nulls")


_MASK_BITS = 63


def fingerprints(df: DataFrame) -> DataFrame:
    """``_h1, _h2`` (two 64-bit hashes of a whole row) and ``_mask0, ...``, the bits of its NULL columns.

    Spark's hash passes over NULLs, so each column is hashed with its NULL mark.
    """
    marked = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    hashes = [F.xxhash64(F.lit(seed), *marked).alias(name) for seed, name in ((0, "_h1"), (1, "_h2"))]
    masks = []
    for at in range(0, len(df.columns), _MASK_BITS):
        bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(df.columns[at : at + _MASK_BITS])]
        masks.append(reduce(add, bits).alias(f"_mask{at // _MASK_BITS}"))
    return df.select(*hashes, *masks)


def repeated_rows(df: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of ``df`` that occur more than once, each once with its number ``__n``.

    ``met``: groups of :func:`fingerprints` with their size ``__n``.  Rows
    without a twin have a fingerprint of their own and mostly go no further.
    """
    words = flag_words(met.where("__n > 1"), "_h1")
    marked = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    likely = with_flag(df, F.xxhash64(F.lit(0), *marked), words).where("_flagged").drop("_flagged")
    return likely.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")


def audit(df: DataFrame, name: str) -> DataFrame:
    """DQ-1/3/4/5/7: ``table_name, n_columns, column_position, column_name, data_type,
    n_rows, n_dup_rows, n_nulls`` (one row per column)."""
    cols = df.columns
    printed = fingerprints(df)
    met = printed.groupBy(*printed.columns).agg(F.count(F.lit(1)).alias("__n"))
    nulls = [
        F.sum(F.getbit(f"_mask{i // _MASK_BITS}", F.lit(i % _MASK_BITS)) * F.col("__n")).alias(f"__null_{i}")
        for i in range(len(cols))
    ]
    counted = met.agg(F.sum("__n").alias("n_rows"), *nulls)
    again = repeated_rows(df, met).agg(F.sum(F.col("__n") - 1).alias("n_dup_rows"))
    # Two results of one row each, added up instead of joined.
    both = counted.unionByName(again, allowMissingColumns=True)
    wide = both.agg(*[F.sum(c).alias(c) for c in both.columns])
    long = wide.select(
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.col("n_dup_rows"), F.lit(0)).cast("long").alias("n_dup_rows"),
        _by_column(df),
    )
    return long.select(
        F.lit(name).alias("table_name"),
        F.lit(len(cols)).alias("n_columns"),
        F.col("c.column_position").alias("column_position"),
        F.col("c.column_name").alias("column_name"),
        F.col("c.data_type").alias("data_type"),
        "n_rows",
        "n_dup_rows",
        F.col("c.n_nulls").alias("n_nulls"),
    )


def audit_all(t: Portfolio) -> DataFrame:
    """DQ-7 applied to the five tables."""
    out = None
    for name, df in t.tables().items():
        a = audit(df, name)
        out = a if out is None else out.unionByName(a)
    return out


def null_columns_all(t: Portfolio) -> DataFrame:
    """DQ-4 applied to the five tables."""
    out = None
    for name, df in t.tables().items():
        n = null_columns(df, name)
        out = n if out is None else out.unionByName(n)
    return out


def row_counts(t: Portfolio) -> DataFrame:
    """DQ-2: ``table_name, n_rows`` for the five tables."""
    out = None
    for name, df in t.tables().items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        out = c if out is None else out.unionByName(c)
    return out


def categories(t: Portfolio) -> DataFrame:
    """DQ-8: distinct values of the categorical columns, long form."""
    parts = [
        t.clients.select(F.lit("country").alias("column_name"), F.col("country").alias("value")),
        t.policies.select(
            F.lit("product_type").alias("column_name"), F.col("product_type").alias("value")
        ),
        t.claims.select(F.lit("status").alias("column_name"), F.col("status").alias("value")),
        t.agents.select(F.lit("region").alias("column_name"), F.col("region").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().orderBy("column_name", F.col("value").asc_nulls_last())


def inverted_contracts(policies: DataFrame) -> DataFrame:
    """DQ-9: ``n_inverted, n_total, pct`` of contracts with start > end (NULL = not inverted)."""
    from ..functions.metrics import div, round_even

    agg = policies.agg(
        F.count_if(F.col("start_date") > F.col("end_date")).alias("n_inverted"),
        F.count(F.lit(1)).alias("n_total"),
    )
    return agg.select(
        "n_inverted",
        "n_total",
        round_even(F.when(F.col("n_total") > 0, div(F.col("n_inverted"), F.col("n_total"), 100.0)), 1)
        .alias("pct"),
    )


def preview(df, key: str, n: int = 5):
    """DQ-6: the first ``n`` rows in ``key`` order (Spark has no implicit row order)."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def table_previews(t: Portfolio, n: int = 3) -> DataFrame:
    """DQ-6 for the five tables: ``table_name, row_text`` of the first ``n`` rows.

    Rows are ordered by all their columns (a total order, so the preview is
    the same on every run); each table is a top-n (``TakeOrderedAndProject``).
    """
    out = None
    for name, df in t.tables().items():
        order = [F.col(c).asc_nulls_last() for c in df.columns]
        text = F.concat_ws(", ", *[F.col(c).cast("string") for c in df.columns])
        part = df.orderBy(*order).limit(n).select(F.lit(name).alias("table_name"), text.alias("row_text"))
        out = part if out is None else out.unionByName(part)
    return out


def clients_without_policy(clients: DataFrame, policies: DataFrame) -> DataFrame:
    """DQ-10 / JN-6 / SO-2: distinct client ids absent from policies.

    Both sides are de-duplicated first (map-side partial aggregation), so a
    client holding a large share of all policies reaches the anti join as
    one row: the right side of an anti join is the one AQE cannot split.
    """
    return (
        clients.select("client_id")
        .distinct()
        .join(policies.select("client_id").distinct(), "client_id", "left_anti")
    )


def date_summary(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """DQ-11: mean contract duration (days) and claim date range, one row.

    The two tables are stacked and aggregated once, so no join of two
    one-row results is needed.
    """
    duration = F.abs(F.datediff("end_date", "start_date"))
    stacked = policies.select(
        duration.alias("d"), F.lit(None).cast("date").alias("claim_date")
    ).unionByName(claims.select(F.lit(None).cast("int").alias("d"), "claim_date"))
    return stacked.agg(
        (F.sum(F.col("d").cast("long")).cast("double") / F.count("d")).alias("mean_days"),
        F.min("claim_date").alias("min_claim"),
        F.max("claim_date").alias("max_claim"),
    )
