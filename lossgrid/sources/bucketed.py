"""Co-located storage: the three policy-keyed tables bucketed by ``policy_id``.

Written once with the same bucket count, ``policies``, ``premiums`` and
``claims`` are hash-partitioned and sorted on ``policy_id`` on disk, so the
per-policy aggregations and the master's joins on ``policy_id`` read
co-partitioned data and plan no exchange for that key; only the dimension
joins (client, agent) still shuffle.  Choose the bucket count so that one
bucket of the largest fact table is a few hundred MB.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.master import DIMENSIONS, verified
from .readers import Portfolio

POLICY_KEYED = ("policies", "premiums", "claims")
#: Table property that names a key checked to be unique when the table was saved.
UNIQUE_KEY = "lossgrid.unique_key"


def _name(database: str | None, table: str) -> str:
    return f"{database}.{table}" if database else table


def save_bucketed(t: Portfolio, n_buckets: int, database: str | None = None,
                  prefix: str = "pf_") -> dict[str, str]:
    """Save the five tables as catalog tables; policy-keyed ones bucketed by policy_id.

    Whether the keys of clients and agents are unique is checked once, on the
    saved tables, and stored with them.
    """
    names = {}
    for table, df in t.tables().items():
        full = _name(database, prefix + table)
        writer = df.write.mode("overwrite").format("parquet")
        if table in POLICY_KEYED:
            writer = writer.bucketBy(n_buckets, "policy_id").sortBy("policy_id")
        writer.saveAsTable(full)
        names[table] = full
    spark = t.policies.sparkSession
    for table in verified(Portfolio(**{table: spark.table(full) for table, full in names.items()})).unique:
        spark.sql(f"ALTER TABLE {names[table]} SET TBLPROPERTIES ('{UNIQUE_KEY}' = '{DIMENSIONS[table]}')")
    return names


def load_bucketed(spark: SparkSession, database: str | None = None, prefix: str = "pf_") -> Portfolio:
    """Read the tables written by :func:`save_bucketed` (buckets and unique keys from the catalog)."""
    names = {table: _name(database, prefix + table) for table in ("agents", "claims", "clients", "policies", "premiums")}
    stored = {
        table: {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {names[table]}").collect()}
        for table in DIMENSIONS
    }
    unique = [table for table, key in DIMENSIONS.items() if stored[table].get(UNIQUE_KEY) == key]
    return Portfolio(**{table: spark.table(full) for table, full in names.items()}).with_unique(unique)
