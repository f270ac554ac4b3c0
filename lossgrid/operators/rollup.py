"""Hierarchical totals with a value-weighted colour (AG-19).

``ROLLUP(k1, k2)`` over leaf rows: sizes add up the tree; the colour of a
parent is the size-weighted mean of its leaves' colours (how a treemap
colours a parent node); leaves keep their own colour.  No leaves, no tree:
an empty input gives no rows (not even a root).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ieee_ratio


def weighted_rollup(leaf: DataFrame, keys: list[str], *, value: str, colour: str,
                    sums: list[str]) -> DataFrame:
    """``level`` (0 = leaf .. len(keys) = root), keys, value, colour, sums."""
    v, c = F.col(value), F.col(colour)
    gid = F.grouping_id(*keys)
    agg = leaf.rollup(*keys).agg(
        gid.alias("gid"),
        F.sum(v).alias(value),
        F.max(c).alias("__leaf_colour"),
        F.sum(v.cast("double") * c).alias("__weighted"),
        *[F.sum(s).alias(s) for s in sums],
    )
    # grouping_id bits: 0 for a leaf, then 1, 3, 7 ... as keys roll up.
    level = F.when(F.col("gid") == 0, 0)
    for i in range(1, len(keys) + 1):
        level = level.when(F.col("gid") == (1 << i) - 1, i)
    colour_col = F.when(F.col("gid") == 0, F.col("__leaf_colour")).otherwise(
        ieee_ratio(F.col("__weighted"), F.col(value))
    )
    return agg.select(
        level.alias("level"),
        *keys,
        F.col(value),
        colour_col.alias(colour),
        *sums,
    )
