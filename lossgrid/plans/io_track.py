"""Queries over what the readers and sinks write and read (SRC-1, SRC-4, SNK-1, SNK-2).

Each writes files to the session's shared folder — the five tables as CSV, the
master as CSV or partitioned Parquet, the chart datasets — and returns what a
reader finds there, so the whole path is compared with the tables it came from.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import dbl
from ..operators.master import master
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.readers import Portfolio, read_csv_portfolio
from . import charts, master_track

#: Every so many clients (by id) get a signup date that is none, for the lenient reader.
UNREADABLE_EVERY = 50
#: Start years that the pruned read takes.
YEARS = [1993, 1995]


def _folder(t: Portfolio, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.policies.sparkSession).rstrip('/')}/lossgrid-{name}-{uuid.uuid4().hex}"


def write_csv_tables(t: Portfolio, folder: str) -> None:
    for name, df in t.tables().items():
        df.write.option("header", True).option("encoding", "UTF-8").csv(f"{folder}/{name}.csv")


def io01_csv_tables(t: Portfolio) -> DataFrame:
    """SRC-1/2/4: rows, ids, money and dates of the five tables after a CSV round trip."""
    folder = _folder(t, "csv")
    write_csv_tables(t, folder)
    read = read_csv_portfolio(t.policies.sparkSession, folder)
    parts = []
    for name, df in read.tables().items():
        kinds = {f.name: f.dataType.typeName() for f in df.schema}
        money = [F.col(c) for c, kind in kinds.items() if kind == "decimal"]
        dates = [F.col(c) for c, kind in kinds.items() if kind == "date"]
        ids = [F.coalesce(F.col(c), F.lit(0)) for c in kinds if c.endswith("_id")]
        days = [F.coalesce(F.unix_date(c), F.lit(0)).cast("long") for c in dates]
        words = [F.coalesce(F.char_length(c), F.lit(0)).cast("long") for c, kind in kinds.items() if kind == "string"]
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.sum(reduce(lambda a, b: a + b, ids)).alias("id_sum"),
                (dbl(F.sum(money[0])) if money else F.lit(None).cast("double")).alias("money_sum"),
                F.sum(reduce(lambda a, b: a + b, days, F.lit(0).cast("long"))).alias("day_sum"),
                F.sum(reduce(lambda a, b: a + b, words, F.lit(0).cast("long"))).alias("letters"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def io02_rejected_rows(t: Portfolio) -> DataFrame:
    """SRC-1/4, lenient: clients whose signup date is no date, found as rejected rows; the others keep theirs."""
    folder = _folder(t, "csv-rejects")
    date = F.when(F.col("client_id") % UNREADABLE_EVERY == 0, F.lit("unknown")).otherwise(F.date_format("signup_date", "yyyy-MM-dd"))
    clients = t.clients.withColumn("signup_date", date)
    for name, df in {**t.tables(), "clients": clients}.items():
        df.write.option("header", True).option("encoding", "UTF-8").csv(f"{folder}/{name}.csv")
    read = read_csv_portfolio(t.policies.sparkSession, folder, lenient=True)
    return read.rejected.select("table_name", "row_text", "null_fields")


def io03_master_csv(t: Portfolio) -> DataFrame:
    """SNK-1: the master as its CSV export gives it back."""
    path = _folder(t, "master-csv")
    sinks.write_master_csv(master(t), path)
    return sinks.read_master_csv(t.policies.sparkSession, path)


def io04_master_years(t: Portfolio, years: list[int] | None = None) -> DataFrame:
    """SNK-1/SRC-3: the P&L by product of some start years, from the folders of these years of the Parquet export."""
    path = _folder(t, "master-parquet")
    sinks.write_master_parquet(master(t), path)
    facts = sinks.stored_facts(t.policies.sparkSession, path, YEARS if years is None else years)
    return master_track.n11_product(t.with_facts(facts))


def io05_chart_datasets(t: Portfolio) -> DataFrame:
    """SNK-2: rows of every written chart dataset, as read back."""
    spark, folder = t.policies.sparkSession, _folder(t, "charts")
    paths = sinks.write_chart_datasets(t, folder)
    parts = [
        spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows")
        for name, path in zip(charts.QUERIES, paths, strict=True)
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "io01_csv_tables": io01_csv_tables,
    "io02_rejected_rows": io02_rejected_rows,
    "io03_master_csv": io03_master_csv,
    "io04_master_years": io04_master_years,
    "io05_chart_datasets": io05_chart_datasets,
}
