"""Thresholded labels (CL-1 .. CL-11) as native column expressions.

Every rule is evaluated top-down with strict ``>`` bounds.  Rules reading a
pandas float test NaN first, because Spark orders NaN above every number
while a pandas comparison with NaN is false.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import is_nan, ratio_exceeds

# --- Fixed values (label texts, colours and bounds of the source project) ---
PNL_ANOMALY = "Anomalie"
PNL_CRITICAL = "CRITIQUE"
PNL_DEFICIT = "DÉFICITAIRE"
PNL_PROFITABLE = "RENTABLE"

YEAR_CRITICAL = "🔴 CRITIQUE"
YEAR_SEVERE = "🟠 GRAVE"
YEAR_HIGH = "🟡 ÉLEVÉ"

AGENT_ALERT_ANOMALY = "🔴 ANOMALIE — Sinistres sans primes"
AGENT_ALERT_CRITICAL = "🔴 CRITIQUE — Audit immédiat"
AGENT_ALERT_SEVERE = "🔴 GRAVE — Investigation requise"
AGENT_ALERT_HIGH = "🟠 ÉLEVÉ — Suivi renforcé"

VERDICT_LOSS = "Perte technique — action urgente"
VERDICT_PROFIT = "Rentable techniquement"

# CLV segments: upper bounds are inclusive, in ascending order.
CLV_SEGMENTS = ("Très déficitaire", "Déficitaire", "Neutre", "Profitable")
CLV_BOUNDS = (-1000, 0, 500)

AGENT_PERF_PROFIT = "🟢 Rentable"
AGENT_PERF_LOSS = "🔴 Déficitaire"
AGENT_STATUS_PROFIT = "Rentable"
AGENT_STATUS_LOSS = "Déficitaire"

RED = "#C0392B"
ORANGE = "#E67E22"
GREEN = "#27AE60"

TOP_GROUP = "🟢 Top 10"
BOTTOM_GROUP = "🔴 Bottom 10"
# ----------------------------------------------------------------------------

# Our own zone names for the gauge / histogram bands (0-80, 80-100, >100).
ZONE_HEALTHY = "sain"
ZONE_LIMIT = "limite"
ZONE_CRITICAL = "critique"


def pnl_signal(premiums: Column, claims: Column) -> Column:
    """CL-1, yearly P&L signal on the unrounded ratio (premiums non-null)."""
    return (
        F.when(F.coalesce(premiums, F.lit(0)) == 0, PNL_ANOMALY)
        .when(ratio_exceeds(claims, premiums, 200), PNL_CRITICAL)
        .when(ratio_exceeds(claims, premiums, 100), PNL_DEFICIT)
        .otherwise(PNL_PROFITABLE)
    )


def year_signal(lr_rounded: Column) -> Column:
    """CL-2, underwriting-year signal on the LR rounded to 1 dp."""
    return (
        F.when(is_nan(lr_rounded) | lr_rounded.isNull(), YEAR_HIGH)
        .when(lr_rounded > 200, YEAR_CRITICAL)
        .when(lr_rounded > 180, YEAR_SEVERE)
        .otherwise(YEAR_HIGH)
    )


def agent_alert(premiums: Column, claims: Column) -> Column:
    """CL-3, alert level from the unrounded agent LR (NULL when premiums = 0)."""
    return (
        F.when(premiums == 0, AGENT_ALERT_ANOMALY)
        .when(premiums.isNull(), AGENT_ALERT_ANOMALY)
        .when(ratio_exceeds(claims, premiums, 500), AGENT_ALERT_CRITICAL)
        .when(ratio_exceeds(claims, premiums, 300), AGENT_ALERT_SEVERE)
        .otherwise(AGENT_ALERT_HIGH)
    )


def combined_verdict(claims: Column, premiums: Column, expense_pct: float) -> Column:
    """CL-4: ``claims / premiums * 100 + expense > 100``, decided exactly on decimals.

    Equivalent to ``(claims + premiums * expense / 100) / premiums * 100 > 100``;
    NULL (no accepted claim) falls to the else branch.
    """
    expense_share = F.lit(Decimal(str(expense_pct)) / 100)
    loss = ratio_exceeds(claims + premiums * expense_share, premiums, 100)
    return F.when(loss, VERDICT_LOSS).otherwise(VERDICT_PROFIT)


def clv_segment(clv: Column) -> tuple[Column, Column]:
    """CL-5, right-closed bins -> (label, ordinal 0..3); NULL stays NULL."""
    lo, mid, hi = CLV_BOUNDS
    ordinal = (
        F.when(clv <= lo, 0).when(clv <= mid, 1).when(clv <= hi, 2).when(clv.isNotNull(), 3)
    )
    label = F.element_at(F.array(*[F.lit(s) for s in CLV_SEGMENTS]), ordinal + 1)
    return label, ordinal


def agent_perf_label(profit: Column) -> Column:
    """CL-6."""
    return F.when(profit > 0, AGENT_PERF_PROFIT).otherwise(AGENT_PERF_LOSS)


def agent_status(profit: Column) -> Column:
    """CL-7."""
    return F.when(profit > 0, AGENT_STATUS_PROFIT).otherwise(AGENT_STATUS_LOSS)


def country_band(lr_rounded: Column) -> Column:
    """CL-8, colour band of a country LR rounded to 1 dp."""
    return (
        F.when(is_nan(lr_rounded) | lr_rounded.isNull(), GREEN)
        .when(lr_rounded > 190, RED)
        .when(lr_rounded > 170, ORANGE)
        .otherwise(GREEN)
    )


def lr_zone(lr: Column) -> Column:
    """CL-9 / CL-10: 0-80 healthy, 80-100 limit, 100 and above critical."""
    return (
        F.when(lr.isNull() | is_nan(lr), None)
        .when(lr < 80, ZONE_HEALTHY)
        .when(lr < 100, ZONE_LIMIT)
        .otherwise(ZONE_CRITICAL)
    )


def profit_colour(profit: Column) -> Column:
    """CL-11."""
    return F.when(profit > 0, GREEN).otherwise(RED)
