"""Ratio, rounding and threshold helpers shared by all queries (PRJ-5/6/8, T3, T11).

Two rounding conventions exist in the workload:

* the SQL track rounds half away from zero (``ROUND(x, n)``).  Ratios are
  doubles; they are first brought to 10 decimals, which removes the binary
  noise of ``a / b * 100`` so that a true tie such as 12.345 rounds up as
  exact decimal arithmetic would;
* the data-frame (master) track rounds half to even on the scaled binary
  value, i.e. ``rint(x * 10^n) / 10^n``.

Money stays DECIMAL until the last step; :func:`dbl` converts it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def dbl(c: Column) -> Column:
    return c.cast("double")


def div(num: Column, den: Column, scale: float | None = None) -> Column:
    """``double(num) / double(den) [* scale]`` with the caller guaranteeing den != 0."""
    q = dbl(num) / dbl(den)
    return q * F.lit(float(scale)) if scale is not None else q


def ratio_or(num: Column, den: Column, otherwise, scale: float | None = None,
             *, guard: str = "positive") -> Column:
    """Guarded ratio: ``num/den*scale`` when ``den > 0`` (or ``!= 0``), else ``otherwise``.

    ``otherwise`` may be a number (0, inf, nan) or ``None`` (NULL).
    """
    cond = den > 0 if guard == "positive" else den != 0
    other = F.lit(None).cast("double") if otherwise is None else F.lit(float(otherwise))
    return F.when(cond, div(num, den, scale)).otherwise(other)


def ieee_ratio(num: Column, den: Column, scale: float | None = None) -> Column:
    """Unguarded float division as in pandas: x/0 is +-inf, 0/0 is NaN."""
    zero_div = (
        F.when(num > 0, F.lit(INF)).when(num < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    )
    return F.when(den != 0, div(num, den, scale)).when(
        (den == 0) & num.isNotNull(), zero_div
    )


def nullif_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def round_sql(x: Column, n: int) -> Column:
    """SQL ``ROUND(x, n)``: half away from zero, on a 10-decimal view of a double."""
    return F.round(x.cast("decimal(38,10)"), n).cast("double")


def round_even(x: Column, n: int) -> Column:
    """numpy/pandas ``round(x, n)``: ``rint(x * 10^n) / 10^n`` (keeps inf and NaN)."""
    if n == 0:
        return F.rint(x)
    p = float(10**n)
    return F.rint(x * F.lit(p)) / F.lit(p)


def ratio_exceeds(num: Column, den: Column, pct: int) -> Column:
    """``num / den * 100 > pct`` decided exactly on decimals (NULL when den is 0 or NULL)."""
    lhs = num * 100
    rhs = den * pct
    return F.when(den > 0, lhs > rhs).when(den < 0, lhs < rhs)


def is_nan(x: Column) -> Column:
    return F.isnan(x) & x.isNotNull()
