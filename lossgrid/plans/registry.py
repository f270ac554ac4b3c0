"""All named queries, callable as ``fn(Portfolio) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import Portfolio
from ..sources.testmap import mapped_portfolio
from . import charts, io_track, master_track, sql_track

QUERIES: dict[str, Callable[[Portfolio], DataFrame]] = {
    **sql_track.QUERIES,
    **master_track.QUERIES,
    **charts.QUERIES,
}

#: Queries over written and reread files; not part of the analysis report.
IO_QUERIES: dict[str, Callable[[Portfolio], DataFrame]] = dict(io_track.QUERIES)


def run_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build query ``name`` over the portfolio mapped from ``sf_dir``."""
    return (QUERIES | IO_QUERIES)[name](mapped_portfolio(spark, sf_dir))
