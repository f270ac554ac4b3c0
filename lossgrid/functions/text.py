"""Text labels of the chart datasets (PRJ-10, PRJ-11), as native expressions.

Numbers are rendered the way Python's ``str`` / format specs render a float:
``nan`` / ``inf`` spelled in lower case, ``.0f`` rounding half to even on the
binary value (``rint``), thousands separators from ``format_number``
(HALF_EVEN as well).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_str(x: Column) -> Column:
    """``str(float)`` of a value rounded to one digit: plain digits below 1e16."""
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16), x.cast("decimal(38,1)").cast("string"))
        .otherwise(x.cast("string"))
    )


def fixed0(x: Column) -> Column:
    """``f'{x:.0f}'``."""
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(F.rint(x).cast("long").cast("string"))
    )


def grouped0(x: Column) -> Column:
    """``f'{x:,.0f}'``."""
    return F.format_number(x, 0)


def signed0(x: Column) -> Column:
    """``f'{x:+,.0f}'``."""
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("+")), F.format_number(F.abs(x), 0))


def agent_label(agent_id: Column, region: Column, experience: Column) -> Column:
    """``Agent {id} | {region[:3]} | {exp}ans``."""
    return F.concat(
        F.lit("Agent "),
        agent_id.cast("string"),
        F.lit(" | "),
        F.substring(region, 1, 3),
        F.lit(" | "),
        experience.cast("string"),
        F.lit("ans"),
    )
