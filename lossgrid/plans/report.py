"""The whole analysis in one run, with the master built once.

Mirrors the source notebook's flow — audit, master, KPIs, chart datasets,
export — but the expensive parts are computed once and cut from their
lineage (:func:`lossgrid.session.materialize`: Parquet in the session's
``spark.checkpoint.dir``): the per-policy premium and claim sides (one pass
over each fact table, read by both tracks), the master rows and the rollups
by client and by agent, so what follows scans the columns it reads of narrow
tables instead of the fact tables.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame

from ..operators.facts import claim_side, premium_side
from ..operators.master import policy_facts
from ..session import materialize, release
from ..sources.readers import Portfolio
from ..sources.sinks import replace_folder
from . import charts, master_track, sql_track

# Queries that read the raw tables rather than the master.
RAW_TABLE_QUERIES = {
    "n01_audit", "n01b_null_columns", "n01c_table_preview", "n02_categories", "n03_inverted_contracts", "n04_clients_without_policy",
    "n04b_clients_without_policy_count", "n05_date_summary", "n06_premiums_agg",
    "n07_claims_all", "n08_claims_accepted", "n16_claim_amount_describe",
}


def build_report(
    t: Portfolio, *, include_sql_track: bool = True, as_of: dt.date | None = sql_track.AS_OF, name: str = "report"
) -> dict[str, DataFrame]:
    """All named results as DataFrames over one materialised master.

    Tenure is reckoned at ``as_of`` (None: the day it runs).  The shared
    tables stay until ``release(spark, name)``.
    """
    sides = t.with_sides(materialize(premium_side(t), name), materialize(claim_side(t), name))
    shared = sides.with_facts(materialize(policy_facts(sides), name))
    shared = shared.with_rollups(
        materialize(master_track.client_clv(shared), name), materialize(master_track.agent_rollup(shared), name)
    )
    out: dict[str, DataFrame] = {}
    if include_sql_track:
        weighted = sides.with_weighted_policies(materialize(sql_track.weighted_policies(sides), name))
        out.update({query: fn(weighted) for query, fn in sql_track.QUERIES.items()})
        out["s05_top_clients_clv"] = sql_track.s05_top_clients_clv(weighted, as_of=as_of)
    for query, fn in master_track.QUERIES.items():
        out[query] = fn(sides if query in RAW_TABLE_QUERIES else shared)
    out.update({query: fn(shared) for query, fn in charts.QUERIES.items()})
    return out


def write_report(t: Portfolio, directory: str | None, fmt: str = "parquet") -> dict[str, str]:
    """Run every result; write each under ``directory`` (or discard with ``noop``)."""
    written = {}
    run = f"report-{uuid.uuid4().hex}"
    for name, df in build_report(t, name=run).items():
        if directory is None:
            df.write.format("noop").mode("overwrite").save()
            continue
        path = os.path.join(directory, name)
        write = df.write.option("header", True).csv if fmt == "csv" else df.write.parquet
        replace_folder(t.policies.sparkSession, path, write)
        written[name] = path
    if directory is not None and t.rejected is not None:
        written["rejected_rows"] = os.path.join(directory, "rejected_rows")
        write = t.rejected.write.option("header", True).csv if fmt == "csv" else t.rejected.write.parquet
        replace_folder(t.policies.sparkSession, written["rejected_rows"], write)
    release(t.policies.sparkSession, run)
    return written
