"""Session helpers: a local session for tests and benches, and lineage cuts.

Tables that are scanned several times go to the folder named by the
session's ``spark.checkpoint.dir`` (the shared folder of a cluster).  A
scratch folder is made only where that is unset, as in tests and ``bench.py``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings every session running these plans should have; AQE re-plans joins
# from runtime sizes (broadcast only what it measured small, split skewed
# partitions) and coalesces small shuffle partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lossgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder below the configured checkpoint folder.

    Where none is configured, a local session gets a scratch folder; on a
    cluster, whose machines would not share it, that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if sc.master.partition("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="lossgrid-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read it back.

    Cuts lineage before a frame is scanned several times, at a table that
    outlives any executor; later scans read only their columns.  The table
    stays until :func:`release`.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lossgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
    """:func:`materialize`, and aggregates of ``df`` that are taken while it is written.

    No further pass over the rows is needed to know them.
    """
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    kept = materialize(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    found = seen.get
    if set(metrics) <= set(found):
        return kept, found
    # A plan that is known to be empty may drop its metrics.
    return kept, kept.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict()


def release(spark: SparkSession, name: str = "*") -> int:
    """Delete this application's materialised tables of that name (all by default); how many went."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/lossgrid-{name}-*")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(path) or [])
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)
