"""lossgrid — portfolio underwriting analytics as Spark DataFrame plans.

Reads agents, clients, policies, premiums and claims; profiles them; builds
one row per policy; and computes profitability, customer value, cohort
retention, agent alerts and chart datasets with native Spark operators.
"""

from .plans.registry import QUERIES, run_query
from .sources.readers import Portfolio, read_csv_portfolio, read_parquet_portfolio
from .sources.testmap import mapped_portfolio

__all__ = [
    "QUERIES",
    "Portfolio",
    "mapped_portfolio",
    "read_csv_portfolio",
    "read_parquet_portfolio",
    "run_query",
]
