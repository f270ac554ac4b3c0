"""Sinks (SNK-1, SNK-2) and the read path of the exported master.

Writes are distributed (one file per task, no ``coalesce(1)``).  An export is
written beside the old one and takes its name when it is complete
(:func:`replace_folder`), so a failed write leaves the old export whole.  The
Parquet master is partitioned by start year; :func:`read_master` reads it with
its declared schema, and a condition on the year — given or met in a join —
opens the folders of these years only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.master import MASTER_COLUMNS, MONEY_COLUMNS, priced_policies
from ..plans.charts import QUERIES as CHART_QUERIES
from ..plans.master_track import agent_rollup
from ..session import materialize, release
from .readers import Portfolio


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` a new folder, then let it take the name ``path``; the old one goes last.

    The new folder stands beside the old one under a name that readers pass
    over.  If ``write`` fails the old folder is untouched; if the swap fails it
    gets its name back.  On a file system whose rename is one step, readers see
    the old or the new export, or for a moment none, but never a mixture.
    """
    base, name = os.path.split(path.rstrip("/"))
    run = uuid.uuid4().hex
    new, old = (os.path.join(base, f"_{name}-{run}-{kind}") for kind in ("new", "old"))
    jvm = spark.sparkContext._jvm
    target, fresh, spare = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(new)
    except BaseException:
        fs.delete(fresh, True)
        raise
    had = fs.exists(target)
    if had and not fs.rename(target, spare):
        fs.delete(fresh, True)
        raise OSError(f"cannot move the old export {path}")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(spare, target)
        fs.delete(fresh, True)
        raise OSError(f"cannot move the new export to {path}")
    if had:
        fs.delete(spare, True)


def write_master_csv(master: DataFrame, path: str) -> None:
    """SNK-1: CSV with header, UTF-8, no index column."""
    rows = master.write.option("header", True).option("encoding", "UTF-8").option("dateFormat", "yyyy-MM-dd")
    replace_folder(master.sparkSession, path, rows.csv)


def write_master_parquet(master: DataFrame, path: str, partition_by: str = "annee_debut") -> None:
    """SNK-1 for scale: Parquet partitioned by contract start year.

    Rows are rebalanced by year first (AQE splits large years), so a year gets
    files of the advisory size and not one from every task.
    """
    rows = master.hint("rebalance", F.col(partition_by)).write.partitionBy(partition_by)
    replace_folder(master.sparkSession, path, rows.parquet)


_KINDS = {
    "product_type": T.StringType(), "start_date": T.DateType(), "end_date": T.DateType(), "region": T.StringType(),
    "country": T.StringType(), "signup_date": T.DateType(), "is_profitable": T.BooleanType(), "loss_ratio": T.DoubleType(),
    **{c: T.DoubleType() for c in MONEY_COLUMNS},
    **{c: T.LongType() for c in ("policy_id", "client_id", "agent_id", "nb_claims", "nb_claims_accepted")},
}
#: The 23 columns of the exported master (the others are whole numbers of 32 bits).
MASTER_SCHEMA = T.StructType([T.StructField(c, _KINDS.get(c, T.IntegerType())) for c in MASTER_COLUMNS])


def read_master(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """The Parquet master export, of the given start years only if any are given.

    The schema is declared, so no file is opened to infer it, and the years
    become a partition filter.
    """
    rows = spark.read.schema(MASTER_SCHEMA).parquet(path).select(*MASTER_COLUMNS)
    return rows if years is None else rows.where(F.col("annee_debut").isin(years))


def read_master_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV master export, typed."""
    rows = spark.read.schema(MASTER_SCHEMA).option("header", True).option("encoding", "UTF-8")
    return rows.option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST").csv(path)


def stored_facts(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """The export as the rows that every rollup reads (:meth:`Portfolio.with_facts`), money exact again.

    Cents below 2^53 survive the export's doubles unchanged.
    """
    rows = read_master(spark, path, years)
    return rows.withColumns({c: F.round(F.col(c).cast("decimal(38,6)"), 2).cast("decimal(30,2)") for c in MONEY_COLUMNS})


def write_chart_datasets(t: Portfolio, directory: str, fmt: str = "parquet") -> list[str]:
    """SNK-2: persist the dataset behind every chart (v01 .. v08) under ``directory``.

    The policies with their totals and the rollup by agent are staged for the
    charts, so the fact tables are read and grouped once.
    """
    spark, run, written = t.policies.sparkSession, f"charts-{uuid.uuid4().hex}", []
    if t.facts is None:
        t = t.with_priced(materialize(priced_policies(t), run))
    if t.agent_rollup is None:
        t = t.with_rollups(t.client_rollup, materialize(agent_rollup(t), run))
    for name, build in CHART_QUERIES.items():
        out = os.path.join(directory, name)
        writer = build(t).write
        write = writer.option("header", True).csv if fmt == "csv" else writer.parquet
        replace_folder(spark, out, write)
        written.append(out)
    release(spark, run)
    return written
