"""Pivot of a small cell table (AG-13).

The cells — an aggregation by row and column key — are written once; the
names of the columns are read from that table and the pivot fills them from
it, so whatever lies below the cells runs once and not a second time to find
the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MOST_COLUMNS = 10_000


def pivot_cells(cells: DataFrame, row: str, column: str, value: str, most: int = MOST_COLUMNS) -> DataFrame:
    """One row for each ``row``, one column for each value of ``column`` that has a cell, in order.

    ``cells`` holds at most one value for each (row, column); a NULL column
    key has no column.  More than ``most`` columns raise an error.
    """
    kept = materialize(cells.select(row, column, value), "pivot-cells")
    names = kept.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1)
    names = [r[0] for r in names.collect()]
    if len(names) > most:
        raise ValueError(f"over {most} values of {column} to make columns of")
    if not names:
        return kept.select(row).distinct()
    return kept.groupBy(row).pivot(column, names).agg(F.first(value))
