"""Equal-width histogram (AG-18).

Bins are ``[i*w, (i+1)*w)`` with ``w = max / bins`` over ``[0, max]``; the
maximum falls in the last bin.  The column is staged once and its maximum is
observed while it is written, so whatever computes the values runs once; the
counts are an ordinary partial/final aggregation of the staged column with at
most ``bins`` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_observed


def equal_width_histogram(values: DataFrame, col: str, bins: int) -> DataFrame:
    """``bin, lo, hi, n`` for the non-null, non-NaN values of ``col`` (>= 0)."""
    v = F.col(col)
    clean = values.select(v.cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    clean, seen = materialize_observed(clean, "histogram-values", top=F.max("v"))
    width = F.lit(seen["top"]).cast("double") / F.lit(float(bins))
    raw = F.when(width > 0, F.floor(F.col("v") / width)).otherwise(F.lit(0))
    b = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = clean.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin",
        (F.col("bin") * width).alias("lo"),
        ((F.col("bin") + 1) * width).alias("hi"),
        "n",
    ).orderBy("bin")
