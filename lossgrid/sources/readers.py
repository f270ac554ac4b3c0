"""Readers for the five portfolio tables (SRC-1 .. SRC-4).

Every reader applies the fixed schema, so no inference pass runs over the
data, and dates are parsed by the scan itself (``FAILFAST`` raises on bad
text just like a strict date parser would).  The lenient mode turns what it
cannot read into NULL and lists the rows concerned with file and text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMAS, TABLE_ORDER, widen_ids


@dataclass(frozen=True)
class Portfolio:
    """The five source tables as lazy DataFrames."""

    agents: DataFrame
    claims: DataFrame
    clients: DataFrame
    policies: DataFrame
    premiums: DataFrame
    # Optional precomputed master rows (DECIMAL money); when set, every
    # rollup reads them instead of re-joining the five tables.
    facts: DataFrame | None = field(default=None, compare=False)
    # Optional precomputed per-policy aggregates of premiums and claims
    # (see lossgrid.operators.facts); both tracks read them when set.
    premium_side: DataFrame | None = field(default=None, compare=False)
    claim_side: DataFrame | None = field(default=None, compare=False)
    # Optional precomputed policies with their two sides, before any dimension
    # (see lossgrid.operators.master.priced_policies).
    priced: DataFrame | None = field(default=None, compare=False)
    # Optional precomputed policy rows carrying the SQL-track fan-out weights.
    weighted_policies: DataFrame | None = field(default=None, compare=False)
    # Optional precomputed rollups by client and by agent (master track).
    client_rollup: DataFrame | None = field(default=None, compare=False)
    agent_rollup: DataFrame | None = field(default=None, compare=False)
    # Dimensions (clients, agents) whose keys are known to be unique: stored
    # with the tables or checked once (lossgrid.operators.master.verified).
    unique: frozenset[str] = field(default=frozenset(), compare=False)
    # Rows that the lenient CSV reader could not read whole (read_rejected).
    rejected: DataFrame | None = field(default=None, compare=False)

    def with_facts(self, facts: DataFrame) -> "Portfolio":
        return replace(self, facts=facts)

    def with_sides(self, premium_side: DataFrame, claim_side: DataFrame) -> "Portfolio":
        return replace(self, premium_side=premium_side, claim_side=claim_side)

    def with_priced(self, priced: DataFrame) -> "Portfolio":
        return replace(self, priced=priced)

    def with_unique(self, names) -> "Portfolio":
        return replace(self, unique=frozenset(names))

    def with_weighted_policies(self, weighted: DataFrame) -> "Portfolio":
        return replace(self, weighted_policies=weighted)

    def with_rollups(self, client_rollup: DataFrame, agent_rollup: DataFrame) -> "Portfolio":
        return replace(self, client_rollup=client_rollup, agent_rollup=agent_rollup)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_ORDER}

    def register(self) -> None:
        """Expose the tables as temp views for ``spark.sql`` (SRC-3)."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)


#: Column that takes the text of a row with a field that cannot be read.
BAD_ROW = "_bad_row"


def read_csv_table(
    spark: SparkSession, path: str, name: str, *, lenient: bool = False, wide_ids: bool = True
) -> DataFrame:
    """One CSV with header, UTF-8, typed by the fixed schema (ids as ``long`` unless ``wide_ids`` is off).

    A field that cannot be read raises an error, or becomes NULL if
    ``lenient``; :func:`read_rejected` gives the rows to which that happened.
    """
    schema = widen_ids(SCHEMAS[name]) if wide_ids else SCHEMAS[name]
    return _csv(spark, lenient).schema(schema).csv(path)


def _csv(spark: SparkSession, lenient: bool):
    return (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", "PERMISSIVE" if lenient else "FAILFAST")
    )


def read_rejected(spark: SparkSession, path: str, name: str, *, wide_ids: bool = True) -> DataFrame:
    """``table_name, file_name, row_text, null_fields``: the rows of one CSV that cannot be read whole.

    A row is rejected if a field has another form than its column or if it has
    too many or too few fields; ``null_fields`` names the columns that the
    lenient reader leaves NULL.  Every column is parsed, so the answer does not
    depend on the columns that a query reads.
    """
    schema = widen_ids(SCHEMAS[name]) if wide_ids else SCHEMAS[name]
    whole = schema.add(BAD_ROW, "string")
    rows = _csv(spark, True).option("columnNameOfCorruptRecord", BAD_ROW).option("columnPruning", False).schema(whole).csv(path)
    empty = F.concat_ws(",", F.array_compact(F.array(*[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in SCHEMAS[name].fields])))
    rows = rows.select(BAD_ROW, F.col("_metadata.file_name").alias("file_name"), empty.alias("null_fields"))
    # The second condition always holds; it keeps all columns in a query that only counts.
    bad = rows.where(F.col(BAD_ROW).isNotNull() & (F.length("null_fields") >= 0))
    return bad.select(F.lit(name).alias("table_name"), "file_name", F.col(BAD_ROW).alias("row_text"), "null_fields")


def read_csv_portfolio(
    spark: SparkSession, directory: str, *, lenient: bool = False, wide_ids: bool = True
) -> Portfolio:
    """``<directory>/<table>.csv`` for the five tables; if ``lenient``, with their ``rejected`` rows."""
    paths = {name: os.path.join(directory, f"{name}.csv") for name in TABLE_ORDER}
    tables = {name: read_csv_table(spark, path, name, lenient=lenient, wide_ids=wide_ids) for name, path in paths.items()}
    if not lenient:
        return Portfolio(**tables)
    rejected = [read_rejected(spark, path, name, wide_ids=wide_ids) for name, path in paths.items()]
    return Portfolio(**tables, rejected=reduce(DataFrame.unionByName, rejected))


def rejected_counts(t: Portfolio) -> DataFrame:
    """``table_name, n_rejected`` of a leniently read portfolio; tables without rejected rows are not listed."""
    if t.rejected is None:
        raise ValueError("only read_csv_portfolio(lenient=True) knows rejected rows")
    return t.rejected.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rejected"))


def read_parquet_portfolio(spark: SparkSession, directory: str, *, wide_ids: bool = True) -> Portfolio:
    """``<directory>/<table>`` Parquet datasets, columns selected in schema order."""
    tables = {}
    for name in TABLE_ORDER:
        schema = widen_ids(SCHEMAS[name]) if wide_ids else SCHEMAS[name]
        df = spark.read.parquet(os.path.join(directory, name))
        tables[name] = df.select(
            *[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]
        )
    return Portfolio(**tables)
