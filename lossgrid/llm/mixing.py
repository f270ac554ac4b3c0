"""Mixing sources to target weights by entropy balancing (operator 4).

Every document gets a rate: how often the mix takes it.  Of all rates that
meet the token constraint of each source (rates times sizes sum to the
source's target) and stay within 0 and ``most`` copies, entropy balancing
takes those nearest to 1 in relative entropy.  Their form is known from the
convex dual: rate = min(most, exp(multiplier x size / mean size)), one multiplier
for each source, so documents are tilted exponentially by their share of the
constraint.

Newton's method solves the dual for all sources at once.  Rates depend on the
source and the size alone, so one pass counts documents by (source, size) and
every iteration is a small aggregation of that table joined to the multipliers,
which stay a DataFrame.

Rates become whole copies: a document takes floor(rate + u) copies with u from
the hash of its id.  What that leaves to the target is then made up: documents
of a five-hundredth of their source's words or more (500 a source at most)
are rounded from the largest down, each so as to undo the error so far; among
all others one shift of u for each source is found by refining its interval
(again by aggregation), which moves as many documents as needed from one copy
to the next.  No source is gathered in one task.
"""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import named, small_side, stage, stage_observed, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: A document of this share of its source's words is rounded on its own.
LARGE_SHARE = 0.002
KEY = ("doc_id", "source", "size")
ADDED = ("source_size", "target", "rate", "copies")
BINS = 256
ROUNDS = 4
#: Steps by Newton's rule; what is open after them is halved instead, which ends for any input.
NEWTON_STEPS = 60
TOLERANCE = 1e-6


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, n_docs, source_size, target of every source (null is one).

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes.  A target stops at ``most`` times its source's size
    and the excess goes to the others by weight until none is above: sources
    stop in the order of that limit over their weight, so running sums over
    the sources tell who stops.  One row for each source is all that meets in
    one task.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # Spark compares strings by their UTF-8 bytes, which is code point order.
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(table, (place % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", most * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / F.sum("weight").over(onward))
    # The first source whose limit is above its share sets the level for all after it.
    open_ = F.col("level") * F.col("weight") < F.col("limit")
    level = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return per.select("source", "n_docs", "source_size", F.when(level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), level * F.col("weight"))).alias("target"))


def _rate(multiplier: Column, tilt: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), multiplier * tilt)))


def multipliers(sizes: DataFrame, per: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, multiplier: Newton steps on the dual, kept within a bracket of the root.

    A source whose target is ``most`` times its size has no finite root; its
    multiplier runs to the bound that makes every rate ``most``.  A target of
    0 gives rates of 0.  A source is done when its words are within
    ``TOLERANCE`` of the target or its bracket is as narrow as doubles tell
    apart; the steps end when all are, however many that takes.
    """
    spread = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    spread = spread.join(per.select(F.col("source").alias("s"), "n_docs", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    spread = stage(spread.withColumn("tilt", F.col("size") * F.col("n_docs") / F.col("source_size")), "sizes-by-source")
    state = stage(per.where("source_size > 0").select("source", F.lit(0.0).alias("multiplier"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high")), "multipliers")
    for turn in count():
        rate = _rate(F.col("multiplier"), F.col("tilt"), most)
        tokens = F.col("n") * F.col("size")
        at = spread.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        sums = at.groupBy("source").agg(
            F.first("target").alias("target"),
            F.first("multiplier").alias("multiplier"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
            F.sum(tokens * rate).alias("got"),
            F.sum(F.when(rate < most, tokens * rate * F.col("tilt")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("high")).otherwise(F.col("multiplier"))
        newton = F.col("multiplier") + gap / F.col("slope")
        # Outside the bracket, or where nothing is left to tilt, take a longer step inside it.
        inside = F.when(F.abs(F.col("multiplier")) < 1, F.col("multiplier") + F.signum(gap)).otherwise(F.col("multiplier") + F.signum(gap) * F.abs(F.col("multiplier")))
        inside = F.when((inside > low) & (inside < high), inside).otherwise((low + high) / 2)
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(inside) if turn < NEWTON_STEPS else (low + high) / 2
        narrow = high - low <= 1e-12 * F.greatest(F.abs(low), F.abs(high), F.lit(1e-3))
        done = narrow | (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
        state = sums.select("source", F.when(done, F.col("multiplier")).otherwise(step).alias("multiplier"), low.alias("low"), high.alias("high"), done.alias("done"))
        state, seen = stage_observed(state, "multipliers", open=F.count_if(~F.col("done")))
        if not seen["open"]:
            return state.select("source", "multiplier")
        state = state.drop("done")


def _rounded(rows: pd.DataFrame) -> pd.DataFrame:
    """Large documents of one source, from the largest down, against the running error."""
    # Arrow hands structs over as dicts, which keeps long ids whole.
    key = [tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows["row"]]
    rows = rows.assign(key=key).sort_values(["size", "u", "key"], ascending=[False, True, True])
    error, copies = 0.0, []
    for size, rate, n in zip(rows["size"], rows["rate"], rows["n_rows"], strict=True):
        low = int(rate)
        c = low + (1 if rate > low and error + (rate - low) * size * n >= size * n / 2 else 0)
        error += (rate - c) * size * n
        copies.append(c)
    return pd.DataFrame({"row": rows["row"], "copies": copies})


def _rated(sizes: DataFrame, per: DataFrame, most: int) -> DataFrame:
    """Add source_size, target, shift, rate, point (rate + u) and large to rows with doc_id, source, size."""
    facts = small_side(per.withColumnRenamed("source", "_s"))
    at = sizes.join(facts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rate = F.when((F.col("size") > 0) & (F.col("target") > 0), _rate(F.col("multiplier"), F.col("size") * F.col("n_docs") / F.col("source_size"), most)).otherwise(0.0)
    hashed = F.pmod(F.xxhash64(F.col("doc_id"), F.col("size"), F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    at = at.withColumn("rate", rate).withColumn("point", F.col("rate") + hashed).withColumn("large", F.col("size") >= F.greatest(F.lit(1.0), F.col("source_size") * LARGE_SHARE))
    return at.drop("n_docs", "multiplier")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """What :func:`apply` needs: a row for each source, and the copies of the large documents."""
    sizes = stage(sizes.select("doc_id", "source", "size"), "sizes")
    per = stage(targets(sizes, weights, most), "targets")
    tilts = multipliers(sizes, per, most)
    per = stage(per.join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n_docs", "source_size", "target", "multiplier"), "sources")
    rated = _rated(sizes, per, most)

    # Large documents: at most 1 / LARGE_SHARE of a source.  Equal rows are one.
    large = rated.where("large").groupBy(F.struct("doc_id", "source", "size").alias("row"), "size", "rate", (F.col("point") - F.col("rate")).alias("u")).agg(F.count("*").alias("n_rows"))
    large = large.withColumn("s", F.col("row.source"))
    own = large.schema["row"].dataType.simpleString()
    large = stage(large.groupBy("s").applyInPandas(_rounded, f"row {own}, copies long").select("row.*", "copies"), "large")

    # The others: shift u so that what is left of each target is met.
    small = stage(rated.where("not large and size > 0").select("source", "size", "point"), "points")
    taken = sizes.join(small_side(large.select(F.struct("doc_id", "source", "size").alias("row"), "copies")), F.struct("doc_id", "source", "size").eqNullSafe(F.col("row")))
    taken = taken.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    need = per.select("source", "target").join(taken, F.col("source").eqNullSafe(F.col("s")), "left")
    state = stage(need.select(F.col("source").alias("s"), (F.col("target") - F.coalesce("got", F.lit(0))).alias("need"), F.lit(-float(most)).alias("low"), F.lit(float(most)).alias("high")), "shifts")
    for _ in range(ROUNDS):
        state = stage(_refined(small, state, most), "shifts")
    per = stage(per.join(state.select("s", F.col("low").alias("shift")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "sources")
    return per, large.select("doc_id", "source", "size", "copies")


def apply(rows: DataFrame, planned: tuple[DataFrame, DataFrame], most: int = MOST_COPIES) -> DataFrame:
    """Add source_size, target, rate and copies to rows with doc_id, source, size and any other column.

    Columns of those four names are replaced; all others, whatever their names,
    come back as they are.
    """
    per, large = planned
    row = F.struct("doc_id", "source", "size")
    taken = small_side(large.select(row.alias("_row"), F.col("copies").alias("_copies")))
    kept = [c for c in rows.columns if c.lower() not in ADDED]
    # Other columns travel as one struct, so that none of their names can clash.
    others = [named(c).alias(c) for c in kept if c.lower() not in KEY]
    packed = rows.select(*KEY, F.struct(*(others or [F.lit(0)])).alias("_others"))
    at = _rated(packed, per, most).join(taken, row.eqNullSafe(F.col("_row")), "left")
    own = _copies(F.col("point"), F.coalesce("shift", F.lit(0.0)), most).cast("long")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.coalesce("_copies", own)).cast("long")
    whole = at.withColumn("copies", copies)
    return whole.select(*(F.col(c) if c.lower() in KEY else F.col("_others").getField(c).alias(c) for c in kept), *ADDED)


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add source_size, target, rate and copies to every row of ``sizes``.

    ``sizes``: doc_id, source (null is a source of its own), size (long, not
    negative), any other column.  Copies are whole and at most ``most``;
    documents without words get rate 0 and 0 copies.  Rows that are equal in
    doc_id, source and size get equal copies.  The same rows give the same
    copies in any partitioning.  An empty table gives an empty table.
    """
    return apply(sizes, plan(sizes, weights, most), most)


def _copies(point: Column, shift: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.floor(point + shift)))


def _refined(small: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """Narrow each source's interval of shifts to the bin in which its need is met.

    With a greater shift a document moves up a copy where point + shift passes
    a whole number; the words gained by bin of that shift are summed before
    the shuffle.  Only ``state`` may be broadcast, to the documents; tables of
    a row or a few for each source meet by merging, as every broadcast relation
    holds a whole memory page in each executor.
    """
    at = small.join(state, F.col("source").eqNullSafe(F.col("s")))
    width = (F.col("high") - F.col("low")) / BINS
    base = at.groupBy("s").agg(F.sum(F.col("size") * _copies(F.col("point"), F.col("low"), most)).alias("base"))
    # A document passes whole number k at shift k - point, for k from 1 to most.
    steps = at.select("s", "size", "low", "high", F.explode(F.array(*(F.lit(float(k)) - F.col("point") for k in range(1, most + 1)))).alias("shift")).where("shift > low and shift <= high")
    bins = steps.groupBy("s", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.ceil((F.col("shift") - F.col("low")) / width) - 1)).cast("int").alias("bin")).agg(F.sum("size").alias("gain"))
    running = bins.withColumn("upto", F.sum("gain").over(W.partitionBy("s").orderBy("bin")))
    known = state.withColumnRenamed("s", "own").join(base.hint("merge"), F.col("own").eqNullSafe(F.col("s")), "left").select("own", "need", "low", "high", F.coalesce("base", F.lit(0.0)).alias("base"))
    # The last bin whose words still fit into the need.
    fit = running.join(known.hint("merge"), F.col("s").eqNullSafe(F.col("own"))).where("base + upto <= need").groupBy("s").agg(F.max("bin").alias("bin"))
    joined = known.join(fit.hint("merge"), F.col("own").eqNullSafe(F.col("s")), "left")
    low = F.col("low") + (F.coalesce(F.col("bin"), F.lit(-1)) + 1) * width
    return joined.select(F.col("own").alias("s"), "need", F.least(low, F.col("high")).alias("low"), F.least(low + width, F.col("high")).alias("high"))


def document_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null text: 0) of every row."""
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
