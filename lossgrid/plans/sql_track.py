"""SQL-track queries s01 .. s11 — the KPI statements' semantics, exactly as written.

These statements join premiums and accepted claims on ``policy_id`` without
pre-aggregating (T1), count ``nb_polices`` only over policies having a
premium (T2/T10), guard ratios with ``= 0 -> NULL`` and round half away from
zero.  The fan-out is reproduced *exactly* from the per-policy fact sides
(:func:`lossgrid.operators.facts.weighted_fanout`) instead of materialising
``premiums x claims`` pairs, so a policy with many rows on both sides costs
one row, not their product.  ``COUNT(DISTINCT policy_id)`` becomes a
two-level aggregation keyed first by ``(group, policy_id)``.

NULL ordering follows PostgreSQL (ASC nulls last, DESC nulls first) and
every top-k adds its key as tie-break (T7, T17).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.metrics import dbl, div, nullif_zero, ratio_exceeds, round_sql
from ..functions.ordering import pg_asc, pg_desc
from ..operators import quality
from ..operators.facts import accepted, claim_side, fanout_weights, premium_side, weighted_fanout
from ..sources.readers import Portfolio
from ..sources.schemas import EXPENSE_RATIO_PCT, MIN_POLICIES_PER_AGENT

# The statement's CURRENT_DATE is the parameter as_of (T9); this is its one default.
AS_OF = dt.date(2025, 12, 31)


def _grouped_fanout(t: Portfolio, keys: list[str], policy_cols: tuple[str, ...] = (),
                    dim: DataFrame | None = None, dim_key: str | None = None) -> DataFrame:
    """Aggregate ``[dim ⋈] policies ⋈ premiums ⟕ accepted claims`` by ``keys``.

    Groups that are rows of the dimension (per agent, per client) are summed
    by the dimension's key before it is joined: one row per policy on the
    ``policy_id`` partitioning of the fact joins, then one per key with
    map-side combining, so a key with a third of all policies is never
    gathered.  A dimension row that occurs k times repeats its joined rows,
    hence sums and row counts count k times and distinct policies once.
    Other groups (per country) join the dimension first, and the first
    aggregation level reuses the ``policy_id`` partitioning.

    Output: keys, nb (COUNT DISTINCT policy_id), sp (SUM pr.amount), sc
    (SUM c.claim_amount, NULL when none), n_ids (COUNT c.claim_id), n_amt
    (COUNT c.claim_amount), first_start (MIN start_date when present).
    """
    dim_cols = [dim_key] if dim is not None else []
    left = t.policies.select("policy_id", *policy_cols, *dim_cols)
    by_key = dim is not None and dim_key in keys
    if t.weighted_policies is not None:
        # Report mode: the weighted policy rows were materialised once.
        weights = ("w_prem_amount", "w_claim_amount", "w_claim_ids", "w_claim_amounts")
        w = t.weighted_policies.select("policy_id", *policy_cols, *dim_cols, *weights)
        if dim is not None and not by_key:
            w = dim.join(w, dim_key)
    elif dim is not None and not by_key:
        w = weighted_fanout(dim.join(left, dim_key), t)
    else:
        w = weighted_fanout(left, t)
    has_start = "start_date" in policy_cols
    group = [dim_key] if by_key else keys
    per_policy = w.groupBy(*group, "policy_id").agg(
        F.sum("w_prem_amount").alias("sp"),
        F.sum("w_claim_amount").alias("sc"),
        F.sum("w_claim_ids").alias("n_ids"),
        F.sum("w_claim_amounts").alias("n_amt"),
        *([F.min("start_date").alias("first_start")] if has_start else []),
    )
    sums = per_policy.groupBy(*group).agg(
        F.count("policy_id").alias("nb"),
        F.sum("sp").alias("sp"),
        F.sum("sc").alias("sc"),
        F.sum("n_ids").alias("n_ids"),
        F.sum("n_amt").alias("n_amt"),
        *([F.min("first_start").alias("first_start")] if has_start else []),
    )
    if not by_key:
        return sums
    rows = dim.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return rows.join(sums, dim_key).select(
        *keys,
        "nb",
        *[(F.col(c) * F.col("copies")).alias(c) for c in ("sp", "sc", "n_ids", "n_amt")],
        *(["first_start"] if has_start else []),
    )


def _sp() -> Column:
    """SUM(pr.amount) over the joined rows."""
    return F.col("sp")


def _sc() -> Column:
    """SUM(c.claim_amount) over the joined rows (NULL when no accepted claim)."""
    return F.col("sc")


def _sin0() -> Column:
    """COALESCE(SUM(c.claim_amount), 0)."""
    return F.coalesce(F.col("sc"), F.lit(0))


def _nb() -> Column:
    """COUNT(DISTINCT p.policy_id)."""
    return F.col("nb")


def _lr_unrounded() -> Column:
    """``CASE WHEN SUM(pr)=0 THEN NULL ELSE COALESCE(SUM(c),0)/SUM(pr)*100 END``."""
    return F.when(_sp() != 0, div(_sin0(), _sp(), 100.0))


def _lr2() -> Column:
    return round_sql(_lr_unrounded(), 2)


def _per_policy(x: Column) -> Column:
    return div(x, nullif_zero(_nb()))


def s01_pnl_by_year(t: Portfolio) -> DataFrame:
    """Premiums by payment year beside accepted claims by claim year (full outer join)."""
    yp = (
        t.premiums.filter(F.col("payment_date").isNotNull())
        .groupBy(F.year("payment_date").alias("annee"))
        .agg(F.sum("amount").alias("yp"))
    )
    yc = (
        accepted(t.claims)
        .groupBy(F.year("claim_date").alias("annee"))
        .agg(F.sum("claim_amount").alias("yc"))
    )
    j = yp.join(yc, "annee", "full")
    prem = F.coalesce(F.col("yp"), F.lit(0))
    sin = F.coalesce(F.col("yc"), F.lit(0))
    out = j.select(
        "annee",
        dbl(prem).alias("total_primes"),
        dbl(sin).alias("total_sinistres"),
        dbl(prem - sin).alias("profit_technique"),
        F.when(prem != 0, round_sql(div(sin, F.col("yp"), 100.0), 2)).alias("loss_ratio_pct"),
        L.pnl_signal(F.col("yp"), F.col("yc")).alias("signal"),
    )
    return out.orderBy(pg_asc(F.col("annee")))


def _money_block() -> list[Column]:
    return [
        dbl(_sp()).alias("total_primes"),
        dbl(_sin0()).alias("total_sinistres"),
    ]


def s02_product_profitability(t: Portfolio) -> DataFrame:
    """P&L, loss ratio, frequency, severity and risk cost by product, fan-out included."""
    g = _grouped_fanout(t, ["product_type"], ("product_type",))
    out = g.select(
        "product_type",
        _nb().alias("nb_polices"),
        *_money_block(),
        dbl(_sp() - _sin0()).alias("profit_technique"),
        _lr2().alias("loss_ratio_pct"),
        round_sql(_per_policy(F.col("n_ids")), 3).alias("frequence_sinistralite"),
        round_sql(div(_sc(), nullif_zero(F.col("n_amt"))), 2).alias("cout_moyen_sinistre"),
        round_sql(_per_policy(_sin0()), 2).alias("risk_cost_par_police"),
    )
    return out.orderBy(pg_desc(F.col("loss_ratio_pct")), "product_type")


def s03_country_performance(t: Portfolio) -> DataFrame:
    """P&L, loss ratio, result per policy and share of premiums by client country."""
    g = _grouped_fanout(t, ["country"], dim=t.clients.select("client_id", "country"), dim_key="client_id")
    everything = Window.partitionBy()
    share = (dbl(_sp()) * F.lit(100.0)) / dbl(nullif_zero(F.sum(_sp()).over(everything)))
    out = g.select(
        "country",
        _nb().alias("nb_polices"),
        *_money_block(),
        dbl(_sp() - _sin0()).alias("profit_technique"),
        _lr2().alias("loss_ratio_pct"),
        round_sql(_per_policy(_sp() - _sin0()), 2).alias("profit_par_police"),
        round_sql(share, 1).alias("part_ca_pct"),
    )
    return out.orderBy(pg_desc(F.col("loss_ratio_pct")), "country")


AGENT_KEYS = ["agent_id", "region", "experience_years"]


def _agent_groups(t: Portfolio) -> DataFrame:
    return _grouped_fanout(t, AGENT_KEYS, dim=t.agents.select(*AGENT_KEYS), dim_key="agent_id")


def s04_top_agents(t: Portfolio, k: int = 10) -> DataFrame:
    """The k agents with the highest net profit."""
    g = _agent_groups(t)
    out = g.select(
        *AGENT_KEYS,
        _nb().alias("nb_polices_vendues"),
        *_money_block(),
        dbl(_sp() - _sin0()).alias("profit_net"),
        _lr2().alias("loss_ratio_pct"),
    )
    return out.orderBy(pg_desc(F.col("profit_net")), *[pg_asc(F.col(c)) for c in AGENT_KEYS]).limit(k)


def s05_top_clients_clv(t: Portfolio, k: int = 20, as_of: dt.date | None = AS_OF) -> DataFrame:
    """The k clients with the highest technical CLV, with first policy and tenure.

    Tenure is reckoned at ``as_of``; None means the day the query runs.
    """
    g = _grouped_fanout(
        t,
        ["client_id", "age", "country"],
        ("start_date",),
        dim=t.clients.select("client_id", "age", "country"),
        dim_key="client_id",
    )
    out = g.select(
        "client_id",
        "age",
        "country",
        F.col("first_start").alias("premiere_police"),
        _nb().alias("nb_polices"),
        dbl(_sp()).alias("total_primes_payees"),
        dbl(_sin0()).alias("total_sinistres_recus"),
        dbl(_sp() - _sin0()).alias("clv_technique"),
        _lr2().alias("loss_ratio_pct"),
        (F.year(F.lit(as_of) if as_of else F.current_date()) - F.year("first_start")).alias("anciennete_annees"),
    )
    keys = [pg_asc(F.col(c)) for c in ("client_id", "age", "country")]
    return out.orderBy(pg_desc(F.col("clv_technique")), *keys).limit(k)


def s06_frequency_severity(t: Portfolio) -> DataFrame:
    """Frequency, severity, risk cost, mean premium and cover ratio by product."""
    g = _grouped_fanout(t, ["product_type"], ("product_type",))
    out = g.select(
        "product_type",
        _nb().alias("nb_polices"),
        F.col("n_ids").alias("nb_sinistres_acceptes"),
        round_sql(_per_policy(F.col("n_ids")), 3).alias("frequence"),
        round_sql(div(_sc(), nullif_zero(F.col("n_amt"))), 2).alias("cout_moyen_sinistre"),
        dbl(_sc()).alias("cout_total_sinistres"),
        round_sql(_per_policy(_sc()), 2).alias("risk_cost_par_police"),
        round_sql(_per_policy(_sp()), 2).alias("prime_moyenne_actuelle"),
        round_sql(div(_sp(), nullif_zero(_sc())), 3).alias("ratio_couverture"),
    )
    return out.orderBy(pg_desc(F.col("frequence")), "product_type")


#: Years that a client's bitmap holds: WORDS words of 64 years from FIRST_YEAR on.
FIRST_YEAR, WORDS = 1900, 4


def client_years(policies: DataFrame) -> DataFrame:
    """``annee_cohorte, annee_activite``: one row for each client and year in which a policy of its starts.

    The years of a client are ``bit_or`` words, so one hash aggregation with
    map-side combining holds them.  A start year outside the words' range is
    kept as a row of its own (the filter is pushed to the scan) and gets its
    cohort by a join, so no year is lost.
    """
    last = FIRST_YEAR + 64 * WORDS
    rows = policies.filter(F.col("client_id").isNotNull()).select("client_id", F.year("start_date").alias("y"))
    at = F.col("y") - FIRST_YEAR
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)))
    words = [F.bit_or(F.when(F.floor(at / 64) == w, bit)).alias(f"w{w}") for w in range(WORDS)]
    per_client = rows.groupBy("client_id").agg(F.min("y").alias("annee_cohorte"), *words)
    span = F.sequence(F.lit(FIRST_YEAR), F.lit(last - 1))
    word = F.array(*[F.coalesce(f"w{w}", F.lit(0)) for w in range(WORDS)])

    def held(y):
        return F.getbit(F.get(word, F.floor((y - FIRST_YEAR) / 64).cast("int")), F.pmod(y - FIRST_YEAR, F.lit(64))) == 1

    inside = per_client.select("annee_cohorte", F.explode(F.filter(span, held)).alias("annee_activite"))
    beyond = (F.col("start_date") < F.lit(dt.date(FIRST_YEAR, 1, 1))) | (F.col("start_date") >= F.lit(dt.date(last, 1, 1)))
    others = policies.filter(F.col("client_id").isNotNull() & beyond).select(F.col("client_id").alias("c"), F.year("start_date").alias("annee_activite")).distinct()
    outside = others.join(per_client, F.col("c") == F.col("client_id")).select("annee_cohorte", "annee_activite")
    return inside.union(outside)


def s07_cohort_retention(t: Portfolio) -> DataFrame:
    """Cohort = first start year of a client; retention vs the previous present year.

    One shuffle on ``client_id`` gives each client's cohort together with its
    active years as bits of fixed words (:func:`client_years`), however many
    policies it holds; a second, tiny aggregation counts clients per (cohort,
    year).  This replaces the statement's self-join of policies with the CTE.
    """
    counts = client_years(t.policies).groupBy("annee_cohorte", "annee_activite").agg(
        F.count(F.lit(1)).alias("clients_actifs")
    )
    w = Window.partitionBy("annee_cohorte").orderBy("annee_activite")
    counts = counts.withColumn("prev", F.lag("clients_actifs").over(w))
    prev = F.col("prev")
    out = counts.select(
        "annee_cohorte",
        "annee_activite",
        "clients_actifs",
        prev.alias("clients_annee_precedente"),
        round_sql(div(F.col("clients_actifs") * 100, nullif_zero(prev)), 2).alias("taux_retention_pct"),
        (F.col("annee_activite") - F.col("annee_cohorte")).alias("annee_depuis_souscription"),
    )
    return out.orderBy(pg_asc(F.col("annee_cohorte")), pg_asc(F.col("annee_activite")))


def s08_underperforming_agents(t: Portfolio, min_policies: int = MIN_POLICIES_PER_AGENT) -> DataFrame:
    """Agents with at least 3 policies and a loss ratio above 200 % (or none), with alert level."""
    g = _agent_groups(t).filter(_nb() >= min_policies)
    lr_null = (_sp() == 0) | _sp().isNull()
    flagged = g.filter(ratio_exceeds(_sin0(), _sp(), 200) | lr_null)
    out = flagged.select(
        *AGENT_KEYS,
        _nb().alias("nb_polices_vendues"),
        *_money_block(),
        dbl(_sp() - _sin0()).alias("profit_net"),
        _lr2().alias("loss_ratio_pct"),
        L.agent_alert(_sp(), _sin0()).alias("niveau_alerte"),
    )
    return out.orderBy(pg_desc(F.col("loss_ratio_pct")), "agent_id")


def s09_country_product_heatmap(t: Portfolio) -> DataFrame:
    """Loss ratio (ratio of sums) by country and product."""
    g = _grouped_fanout(
        t,
        ["country", "product_type"],
        ("product_type",),
        dim=t.clients.select("client_id", "country"),
        dim_key="client_id",
    )
    out = g.select(
        "country",
        "product_type",
        _nb().alias("nb_polices"),
        *_money_block(),
        _lr2().alias("loss_ratio_pct"),
    )
    return out.orderBy(pg_asc(F.col("country")), pg_desc(F.col("loss_ratio_pct")), "product_type")


def s10_combined_ratio(t: Portfolio, expense_pct: float = EXPENSE_RATIO_PCT) -> DataFrame:
    """premiums ⟕ accepted claims over the whole table (no policies join)."""
    j = premium_side(t).join(claim_side(t), "policy_id", "left")
    w = j.select(*fanout_weights(F.col("n_prem_rows")))
    g = w.agg(F.sum("w_prem_amount").alias("sp"), F.sum("w_claim_amount").alias("sc"))
    lr = div(_sc(), nullif_zero(_sp()), 100.0)
    return g.select(
        round_sql(lr, 2).alias("loss_ratio_pct"),
        F.lit(float(expense_pct)).alias("expense_ratio_estime_pct"),
        round_sql(lr + F.lit(float(expense_pct)), 2).alias("combined_ratio_estime_pct"),
        L.combined_verdict(_sc(), _sp(), expense_pct).alias("verdict"),
    )


WEIGHTED_POLICY_COLUMNS = ("policy_id", "product_type", "start_date", "client_id", "agent_id")


def weighted_policies(t: Portfolio) -> DataFrame:
    """Policy rows having a premium, with their fan-out weights (shared by s02-s09)."""
    return weighted_fanout(t.policies.select(*WEIGHTED_POLICY_COLUMNS), t)


def s11_row_counts(t: Portfolio) -> DataFrame:
    """DQ-2: row count of each of the five tables."""
    return quality.row_counts(t)


QUERIES = {
    "s01_pnl_by_year": s01_pnl_by_year,
    "s02_product_profitability": s02_product_profitability,
    "s03_country_performance": s03_country_performance,
    "s04_top_agents": s04_top_agents,
    "s05_top_clients_clv": s05_top_clients_clv,
    "s06_frequency_severity": s06_frequency_severity,
    "s07_cohort_retention": s07_cohort_retention,
    "s08_underperforming_agents": s08_underperforming_agents,
    "s09_country_product_heatmap": s09_country_product_heatmap,
    "s10_combined_ratio": s10_combined_ratio,
    "s11_row_counts": s11_row_counts,
}
