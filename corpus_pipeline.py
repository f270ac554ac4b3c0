"""The corpus pipeline: five operators in a row over ``documents``.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; :func:`run`
writes what a stage returns as Parquet to the shared folder and rereads it as
the next one's ``docs``.  All stages but the last return the columns of
``documents``.

1. toxicity: documents scored 0.7 or more go (learned on the labelled rows).
2. exact dedup: one row of each text stays.
3. near duplicates: one document of each group stays (five-word shingles,
   similarity 0.8 or more).
4. mixing: each document is repeated as often as the mix takes it; sources
   weigh 5, 2, 1 in turn.
5. packing: sequences of 2048 tokens.

Every stage takes null, empty and repeated rows as its operator defines, and
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgrid.llm import exact_dedup, minhash, mixing, packing, toxicity
from lossgrid.llm.queries import TOXIC, tokenizer_path
from lossgrid.llm.util import id_fold, named, stage, table, word_count

#: Percent of Jaccard similarity from which documents are near duplicates.
NEAR = 80
#: 25 bands of 5 values miss a pair at 0.80 with probability 0.00005; the 21 bands of 6 made for 0.85 miss it with 0.0017.
NEAR_BAND_ROWS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Score every document with a model learned from this corpus' labels; toxic ones go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), usable=lambda doc_id: id_fold(doc_id, 3) != 1)
    scored = toxicity.score(docs, model, column="_toxicity_score")
    return scored.where(F.col("_toxicity_score") < TOXIC).select(*map(named, docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, percent=NEAR, band_rows=NEAR_BAND_ROWS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it."""
    planned = mixing.plan(mixing.document_sizes(docs))
    # The document travels as one struct, so no column of its can clash.
    sized = docs.select(F.struct(*map(named, docs.columns)).alias("document"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    taken = mixing.apply(sized, planned).where("copies > 0")
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the learned score, min-max hashing or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
