"""Explicit sort keys (T7, T17, T18).

Spark sorts NULL first ascending / last descending and NaN above every
number; PostgreSQL puts NULL last ascending / first descending; pandas puts
NaN last either way.  Every ordered result spells its convention out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pandas_desc(c: Column) -> list[Column]:
    """``sort_values(ascending=False)``: NaN and NULL last."""
    return [F.isnan(c).asc_nulls_last(), c.desc_nulls_last()]


def pandas_asc(c: Column) -> list[Column]:
    """``sort_values()``: NaN and NULL last."""
    return [F.isnan(c).asc_nulls_last(), c.asc_nulls_last()]


def pg_desc(c: Column) -> Column:
    """PostgreSQL ``ORDER BY c DESC`` (NULL first)."""
    return c.desc_nulls_first()


def pg_asc(c: Column) -> Column:
    """PostgreSQL ``ORDER BY c`` (NULL last)."""
    return c.asc_nulls_last()
