"""Connected components by alternating large-star and small-star rounds.

Edges stay a DataFrame throughout.  Each round replaces a node's links by
links to the smallest node it sees; rounds end when the edges no longer change
(a logarithmic number of rounds).  Every round is staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import stage_observed


def redealt(column: Column) -> Column:
    """The same long value as an expression that hides the rows' partitioning.

    A join on it deals both sides anew, which lets adaptive execution split
    the rows of a hot key; a join that reused the partitioning of the group-by
    below could not be split.
    """
    return column.bitwiseXOR(F.lit(0).cast("long"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links may repeat; :func:`_small_star` unites them."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(redealt(F.col("a")).alias("v"), F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), both.a == least.v).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    keyed = least.select(redealt(F.col("a")).alias("v"), "m")
    moved = edges.join(keyed.hint("merge"), edges.a == keyed.v).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is its smallest node.

    Self links and null ends are ignored; without edges the result is empty.
    A round is one job: the number and the hash of its links, which tell
    whether anything moved, are observed while they are written.  Rounds
    broadcast nothing.
    """
    marks = {"n": F.count("*"), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, now = stage_observed(edges, name, **marks)
    before = None
    while now["n"] and now != before:
        before = now
        edges, now = stage_observed(_small_star(_large_star(edges)), name, **marks)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
