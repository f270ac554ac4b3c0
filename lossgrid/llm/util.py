"""Helpers shared by the operators: staged tables, row iteration, fixed patterns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lossgrid.session import ensure_checkpoint_dir

# A word: a run of characters other than the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same pattern for Spark's (Java) regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Those six characters, for bytes.translate.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows taken from an Arrow batch at a time, which bounds the Python strings alive.
SLICE = 256


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage at a table that outlives any executor.  The folder is the
    one in ``spark.checkpoint.dir``; only where that is unset (tests) a scratch
    folder is made.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
    """:func:`stage`, and aggregates of ``df`` taken while it is written, so no job of their own is needed."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    kept = stage(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    found = seen.get
    if set(metrics) <= set(found):
        return kept, found
    # A plan that is known to be empty may drop its metrics.
    return kept, kept.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict()


def release(spark: SparkSession) -> int:
    """Delete every staged table of this session's checkpoint folder; how many went."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/llm-*")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(path) or [])
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most ``rows`` rows, none of them empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def word_count(text: Column) -> Column:
    """Number of words of the whole text (null: 0), in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def named(column: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` for columns of any name; Spark itself reads a dot or back-tick in one as syntax."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batch.rename_columns(names) for batch in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
