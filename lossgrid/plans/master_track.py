"""Master-track queries n01 .. n26 (data-frame semantics, fan-out free).

Conventions of this track (the source is a pandas notebook):

* group keys that are NULL are dropped (pandas ``groupby`` default, T6);
* ratios the notebook does not guard follow float semantics (x/0 = inf,
  0/0 = NaN, T3) and rounding is half-to-even on the scaled value (T11);
* money is summed exactly (DECIMAL) and emitted as DOUBLE.

Every rollup reads :func:`policy_facts`, the lazy master; results of a
group-by over a bounded key (product, country, year, segment) are tiny, so
windows without ``partitionBy`` only ever run over those aggregated rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.metrics import dbl, div, ieee_ratio, ratio_or, round_even
from ..functions.ordering import pandas_desc
from ..operators import quality
from ..operators.facts import accepted, accepted_claim_totals, claim_side, claim_totals, premium_side, premium_totals
from ..operators.master import join_dimension, master, policy_facts
from ..operators.pivot import pivot_cells
from ..operators.selection import (
    fraction_size,
    linear_quantile,
    quantile_ranks,
    rank_cells,
    stage_values,
    top_sum_of_cells,
)
from ..sources.readers import Portfolio


def _primes():
    return F.sum("total_premium").alias("primes")


def _sinistres():
    return F.sum("total_claim_accepted").alias("sinistres")


def _profit():
    return F.sum("profit").alias("profit")


def _keys_present(df: DataFrame, *keys: str) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond)


# --- data quality -------------------------------------------------------------


def n01_audit(t: Portfolio) -> DataFrame:
    """DQ-1..7: per table and column — rows, columns, duplicate rows, NULLs, type."""
    return quality.audit_all(t)


def n01b_null_columns(t: Portfolio) -> DataFrame:
    """DQ-4: only the columns that hold NULLs, with their count."""
    return quality.null_columns_all(t)


def n01c_table_preview(t: Portfolio) -> DataFrame:
    """DQ-6: the first three rows of each table (ordered by all columns)."""
    return quality.table_previews(t, 3)


def n02_categories(t: Portfolio) -> DataFrame:
    """DQ-8: distinct values of country, product_type, status and region."""
    return quality.categories(t)


def n03_inverted_contracts(t: Portfolio) -> DataFrame:
    """DQ-9: contracts whose start date is after their end date."""
    return quality.inverted_contracts(t.policies)


def n04_clients_without_policy(t: Portfolio) -> DataFrame:
    """DQ-10: ids of clients holding no policy."""
    return quality.clients_without_policy(t.clients, t.policies)


def n04b_clients_without_policy_count(t: Portfolio) -> DataFrame:
    """DQ-10: how many clients hold no policy."""
    return quality.clients_without_policy(t.clients, t.policies).agg(
        F.count(F.lit(1)).alias("n_clients_without_policy")
    )


def n05_date_summary(t: Portfolio) -> DataFrame:
    """DQ-11: mean contract duration in days and the claim date range."""
    return quality.date_summary(t.policies, t.claims)


# --- per-policy facts and master ---------------------------------------------


def n06_premiums_agg(t: Portfolio) -> DataFrame:
    """AG-1: premium total per policy."""
    p = premium_totals(t)
    return p.select("policy_id", dbl(F.col("total_premium")).alias("total_premium"))


def n07_claims_all(t: Portfolio) -> DataFrame:
    """AG-1: claim total and count per policy, every status."""
    c = claim_totals(t)
    return c.select("policy_id", dbl(F.col("total_claim")).alias("total_claim"), "nb_claims")


def n08_claims_accepted(t: Portfolio) -> DataFrame:
    """AG-1: accepted-claim total and count per policy."""
    c = accepted_claim_totals(t)
    return c.select(
        "policy_id",
        dbl(F.col("total_claim_accepted")).alias("total_claim_accepted"),
        "nb_claims_accepted",
    )


def n09_master(t: Portfolio) -> DataFrame:
    """One row per policy with client, agent and fact columns (23 columns)."""
    return master(t)


# --- portfolio KPIs ----------------------------------------------------------


def n09b_master_preview(t: Portfolio, n: int = 5) -> DataFrame:
    """DQ-6 on the master: its first rows by policy id."""
    if t.facts is not None:
        return quality.preview(master(t), "policy_id", n)
    # The first policies are found before anything is joined to them.
    first = quality.preview(t.policies, "policy_id", n)
    ids = F.broadcast(first.select("policy_id").distinct())
    few = replace(
        t,
        policies=first,
        premium_side=premium_side(t).join(ids, "policy_id", "left_semi"),
        claim_side=claim_side(t).join(ids, "policy_id", "left_semi"),
    )
    return quality.preview(master(few), "policy_id", n)


def n10_global_kpis(t: Portfolio) -> DataFrame:
    """AG-8/10/11: portfolio totals, loss ratio, margin, mean premium, acceptance, counts."""
    f = policy_facts(t, need=())
    g = f.agg(
        F.sum("total_premium").alias("ca"),
        F.sum("total_claim_accepted").alias("sin"),
        F.sum("profit").alias("pn"),
        F.count("total_premium").alias("n_prem"),
        F.sum("nb_claims_accepted").alias("n_acc"),
        F.sum("nb_claims").alias("n_all"),
        F.count_distinct("client_id").alias("n_clients"),
        F.count(F.lit(1)).alias("n_contrats"),
        F.count_if("is_profitable").alias("n_rentables"),
    )
    return g.select(
        dbl(F.col("ca")).alias("ca_total"),
        dbl(F.col("sin")).alias("sin_total"),
        dbl(F.col("pn")).alias("profit_net"),
        ieee_ratio(F.col("sin"), F.col("ca"), 100.0).alias("lr_global"),
        ieee_ratio(F.col("pn"), F.col("ca"), 100.0).alias("marge_nette"),
        ieee_ratio(F.col("ca"), F.col("n_prem")).alias("panier_moyen"),
        ieee_ratio(F.col("n_acc"), F.col("n_all"), 100.0).alias("taux_accept"),
        "n_clients",
        "n_contrats",
        "n_rentables",
        ieee_ratio(F.col("n_rentables"), F.col("n_contrats"), 100.0).alias("pct_rentable"),
    )


def n11_product(t: Portfolio) -> DataFrame:
    """P&L, loss ratio, margin, frequency and mean claim cost by product (LR desc)."""
    g = (
        _keys_present(policy_facts(t, need=()), "product_type")
        .groupBy("product_type")
        .agg(
            F.count("policy_id").alias("nb_contrats"),
            _primes(),
            _sinistres(),
            _profit(),
            F.sum("nb_claims_accepted").alias("nb_sinistres"),
        )
    )
    prim, sin, prof, nsin = (F.col(c) for c in ("primes", "sinistres", "profit", "nb_sinistres"))
    out = g.select(
        "product_type",
        "nb_contrats",
        dbl(prim).alias("primes"),
        dbl(sin).alias("sinistres"),
        dbl(prof).alias("profit"),
        nsin.alias("nb_sinistres"),
        round_even(ieee_ratio(sin, prim, 100.0), 1).alias("loss_ratio_pct"),
        round_even(ieee_ratio(prof, prim, 100.0), 1).alias("profit_pct_ca"),
        round_even(ieee_ratio(nsin, F.col("nb_contrats")), 3).alias("frequence"),
        round_even(F.when(nsin > 0, div(sin, nsin)).otherwise(F.lit(0.0)), 2).alias("cout_moyen"),
    )
    return out.orderBy(*pandas_desc(F.col("loss_ratio_pct")), "product_type")


def _country_rollup(t: Portfolio) -> DataFrame:
    return (
        _keys_present(policy_facts(t, need=("clients",)), "country")
        .groupBy("country")
        .agg(F.count("policy_id").alias("nb"), _primes(), _sinistres(), _profit())
    )


def n12_country(t: Portfolio) -> DataFrame:
    """P&L, loss ratio, share of premiums and result per contract by country (LR desc)."""
    # The grand total over the (few) country rows, computed once.
    g = _country_rollup(t).withColumn("all_primes", F.sum("primes").over(Window.partitionBy()))
    prim, sin, prof = F.col("primes"), F.col("sinistres"), F.col("profit")
    out = g.select(
        "country",
        "nb",
        dbl(prim).alias("primes"),
        dbl(sin).alias("sinistres"),
        dbl(prof).alias("profit"),
        round_even(ieee_ratio(sin, prim, 100.0), 1).alias("lr_pct"),
        round_even(ieee_ratio(prim, F.col("all_primes"), 100.0), 1).alias("part_ca_pct"),
        round_even(ieee_ratio(prof, F.col("nb")), 0).alias("perte_unit"),
    )
    return out.orderBy(*pandas_desc(F.col("lr_pct")), "country")


def _mean_lr_cells(t: Portfolio) -> DataFrame:
    return (
        _keys_present(policy_facts(t, need=("clients",)), "country", "product_type")
        .groupBy("country", "product_type")
        .agg(F.avg("loss_ratio").alias("lr"))
    )


def n13_country_product_mean_lr(t: Portfolio) -> DataFrame:
    """AG-12: unweighted mean of per-policy LR (zero-premium policies count as 0)."""
    cells = _mean_lr_cells(t)
    return cells.select("country", "product_type", round_even(F.col("lr"), 1).alias("lr")).orderBy(
        "country", "product_type"
    )


def n13b_country_product_pivot(t: Portfolio) -> DataFrame:
    """AG-13: the same means, one column for each product that has a cell (names in order).

    The products are read from the written cells, so none can be missed and
    the facts are joined once.
    """
    cells = _mean_lr_cells(t).select("country", "product_type", round_even(F.col("lr"), 1).alias("lr"))
    return pivot_cells(cells, "country", "product_type", "lr").orderBy("country")


def n14_yearly(t: Portfolio) -> DataFrame:
    """P&L by contract start year with premium growth and the year signal."""
    g = (
        _keys_present(policy_facts(t, need=()), "annee_debut")
        .groupBy("annee_debut")
        .agg(F.count("policy_id").alias("nb_contrats"), _primes(), _sinistres(), _profit())
    )
    # Previous present year over the (few) yearly rows.
    g = g.withColumn("prev_primes", F.lag("primes").over(Window.orderBy("annee_debut")))
    prim, sin = F.col("primes"), F.col("sinistres")
    lr = round_even(ieee_ratio(sin, prim, 100.0), 1)
    growth = (ieee_ratio(prim, F.col("prev_primes")) - F.lit(1.0)) * F.lit(100.0)
    out = g.select(
        "annee_debut",
        "nb_contrats",
        dbl(prim).alias("primes"),
        dbl(sin).alias("sinistres"),
        dbl(F.col("profit")).alias("profit"),
        lr.alias("lr_pct"),
        round_even(growth, 1).alias("croissance_pct"),
    )
    return out.withColumn("signal", L.year_signal(F.col("lr_pct"))).orderBy("annee_debut")


def n15_risk_by_product(t: Portfolio) -> DataFrame:
    """Frequency, severity, risk cost and acceptance rate by product."""
    g = (
        _keys_present(policy_facts(t, need=()), "product_type")
        .groupBy("product_type")
        .agg(
            F.count("policy_id").alias("n_polices"),
            F.sum("nb_claims_accepted").alias("n_sin_acceptes"),
            F.sum("nb_claims").alias("n_sin_total"),
            F.sum("total_claim_accepted").alias("cout"),
        )
    )
    n_pol, n_acc, n_all, cout = (
        F.col(c) for c in ("n_polices", "n_sin_acceptes", "n_sin_total", "cout")
    )
    out = g.select(
        "product_type",
        "n_polices",
        "n_sin_acceptes",
        "n_sin_total",
        dbl(cout).alias("cout_total_sin"),
        round_even(ieee_ratio(n_acc, n_pol), 3).alias("frequence"),
        round_even(F.when(n_acc > 0, div(cout, n_acc)).otherwise(F.lit(0.0)), 2).alias("cout_moyen"),
        round_even(ieee_ratio(cout, n_pol), 2).alias("risk_cost"),
        round_even(ieee_ratio(n_acc, n_all, 100.0), 1).alias("taux_accept_pct"),
    )
    return out.orderBy(*pandas_desc(F.col("frequence")), "product_type")


def n16_claim_amount_describe(t: Portfolio) -> DataFrame:
    """AG-14 on accepted claim amounts: exact quantiles from a staged column scanned once more."""
    v = F.col("claim_amount")
    amounts = accepted(t.claims).where(v.isNotNull())
    # The squares are added up as exact decimals while the column is written.
    staged = stage_values(amounts, "claim_amount", "claim-amounts", squares=F.sum(F.col("v") * F.col("v")))
    n, probs = staged.count, (0.25, 0.5, 0.75)
    cells, order = rank_cells(staged, quantile_ranks(n, list(probs)) if n else [])
    qs = [linear_quantile(order, n, p) if n else None for p in probs]
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    size, mean = F.col("n"), div(F.col("s"), F.col("n"))
    squares = F.lit(staged.extra["squares"]).cast("double")
    spread = F.greatest((squares - size * mean * mean) / (size - 1), F.lit(0.0))
    return total.select(
        size.alias("count"),
        round_even(F.when(size > 0, mean), 2).alias("mean"),
        round_even(F.when(size > 1, F.sqrt(spread)), 2).alias("std"),
        round_even(dbl(F.col("lo")), 2).alias("min"),
        *[round_even(F.lit(q).cast("double"), 2).alias(name) for q, name in zip(qs, ("p25", "p50", "p75"))],
        round_even(dbl(F.col("hi")), 2).alias("max"),
    )


# --- clients -----------------------------------------------------------------


def client_clv(t: Portfolio) -> DataFrame:
    """Per-client rollup with DECIMAL money (internal form of n17)."""
    if t.client_rollup is not None:
        return t.client_rollup
    g = (
        _keys_present(policy_facts(t, need=()), "client_id")
        .groupBy("client_id")
        .agg(
            F.count("policy_id").alias("nb_contrats"),
            _primes(),
            _sinistres(),
            F.sum("profit").alias("clv"),
        )
    )
    label, ordinal = L.clv_segment(F.col("clv"))
    prim, sin = F.col("primes"), F.col("sinistres")
    return g.select(
        "client_id",
        "nb_contrats",
        "primes",
        "sinistres",
        "clv",
        round_even(ratio_or(sin, prim, 0.0, 100.0), 1).alias("lr_pct"),
        label.alias("segment"),
        ordinal.alias("segment_order"),
    )


def _money_out(df: DataFrame, *money: str) -> DataFrame:
    return df.select(*[dbl(F.col(c)).alias(c) if c in money else F.col(c) for c in df.columns])


def n17_client_clv(t: Portfolio) -> DataFrame:
    """Customer lifetime value per client with its loss ratio and segment."""
    return _money_out(client_clv(t), "primes", "sinistres", "clv")


def n18_clv_segments(t: Portfolio) -> DataFrame:
    """Clients, CLV total and mean, and share of clients per CLV segment."""
    clv = client_clv(t)
    g = clv.groupBy("segment_order", "segment").agg(
        F.count("client_id").alias("nb"),
        F.sum("clv").alias("clv_total"),
        F.count("clv").alias("n_clv"),
    )
    # Every client counts in the share, including any without a segment.
    g = g.withColumn("all_clients", F.sum("nb").over(Window.partitionBy()))
    out = g.select(
        "segment_order",
        "segment",
        "nb",
        round_even(dbl(F.col("clv_total")), 0).alias("clv_total"),
        round_even(div(F.col("clv_total"), F.col("n_clv")), 0).alias("clv_moyen"),
        round_even(ieee_ratio(F.col("nb"), F.col("all_clients"), 100.0), 1).alias("part_pct"),
    )
    return out.filter(F.col("segment").isNotNull()).orderBy("segment_order")


def n19_clv_concentration(t: Portfolio) -> DataFrame:
    """AG-20: top 20 % / 10 % and bottom 10 % CLV sums, exact at any size."""
    staged = stage_values(client_clv(t), "clv", "client-values")
    n20 = fraction_size(staged.rows, 0.20)
    n10 = fraction_size(staged.rows, 0.10)
    wanted = {}
    if n20:
        wanted["t20"] = staged.count - n20
    if n10:
        wanted["t10"] = staged.count - n10
        wanted["b10"] = n10 - 1
    # Cut at zero as well, so that the clients above it can be counted.
    cells, order = rank_cells(staged, list(wanted.values()), cuts=(0.0,))
    th = {k: order[r] for k, r in wanted.items()}
    g = cells.agg(
        F.coalesce(F.sum(F.when(F.col("lo") > 0, F.col("n"))), F.lit(0)).alias("n_rentables"),
        F.sum("s").alias("total"),
        top_sum_of_cells(n20, th.get("t20")).alias("top20"),
        top_sum_of_cells(n10, th.get("t10")).alias("top10"),
        top_sum_of_cells(n10, th.get("b10"), largest=False).alias("bot10"),
    ).withColumn("n_clients", F.lit(staged.rows).cast("long"))
    return g.select(
        "n_clients",
        "n_rentables",
        round_even(ieee_ratio(F.col("n_rentables"), F.col("n_clients"), 100.0), 1).alias("pct_rentables"),
        dbl(F.col("top20")).alias("top20_clv"),
        round_even(ieee_ratio(F.col("top20"), F.col("total"), 100.0), 1).alias("top20_pct_total"),
        dbl(F.col("top10")).alias("top10_clv"),
        dbl(F.col("bot10")).alias("bot10_clv"),
        round_even(F.abs(ieee_ratio(F.col("bot10"), F.col("top10"))), 2).alias("ratio_bot10_top10"),
    )


_CLIENT_COLS = ("client_id", "nb_contrats", "primes", "sinistres", "clv", "lr_pct")


def n20_top10_clients(t: Portfolio) -> DataFrame:
    """SL-4: the 10 clients with the highest CLV (ties: lower id first)."""
    c = client_clv(t).orderBy(F.col("clv").desc_nulls_last(), "client_id").limit(10)
    return _money_out(c.select(*_CLIENT_COLS), "primes", "sinistres", "clv")


def n21_bottom10_clients(t: Portfolio) -> DataFrame:
    """SL-4: the 10 clients with the lowest CLV (ties: lower id first)."""
    c = client_clv(t).orderBy(F.col("clv").asc_nulls_last(), "client_id").limit(10)
    return _money_out(c.select(*_CLIENT_COLS), "primes", "sinistres", "clv")


# --- agents ------------------------------------------------------------------

AGENT_KEYS = ("agent_id", "region", "experience_years")


def agent_rollup(t: Portfolio) -> DataFrame:
    """Per-agent rollup with DECIMAL money (shared by n22-n26 and v05/v06).

    Policies are summed by ``agent_id`` first; the agents then join one row
    per id, and rows of one id with different attributes stay apart.
    """
    if t.agent_rollup is not None:
        return t.agent_rollup
    sums = (F.count("policy_id").alias("nb_contrats"), _primes(), _sinistres(), _profit())
    if t.facts is not None:
        return _keys_present(t.facts, *AGENT_KEYS).groupBy(*AGENT_KEYS).agg(*sums)
    per_id = _keys_present(policy_facts(t, need=(), later=("agents",)), "agent_id").groupBy("agent_id").agg(*sums)
    rows = _keys_present(join_dimension(per_id, t, "agents"), *AGENT_KEYS)
    return rows.groupBy(*AGENT_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("nb_contrats", "primes", "sinistres", "profit")]
    )


def agent_performance(t: Portfolio) -> DataFrame:
    """Per-agent P&L with loss ratio (+inf without premium) and label, DECIMAL money."""
    g = agent_rollup(t)
    return g.select(
        *AGENT_KEYS,
        "nb_contrats",
        "primes",
        "sinistres",
        "profit",
        round_even(ratio_or(F.col("sinistres"), F.col("primes"), float("inf"), 100.0), 1).alias("lr_pct"),
        L.agent_perf_label(F.col("profit")).alias("perf_label"),
    )


def n22_agent_performance(t: Portfolio) -> DataFrame:
    """P&L, loss ratio and performance label per agent."""
    return _money_out(agent_performance(t), "primes", "sinistres", "profit")


def n23_top10_agents(t: Portfolio) -> DataFrame:
    """SL-4: the 10 most profitable agents."""
    a = agent_performance(t).orderBy(F.col("profit").desc_nulls_last(), *AGENT_KEYS).limit(10)
    a = a.select(*AGENT_KEYS, "nb_contrats", "primes", "profit", "lr_pct")
    return _money_out(a, "primes", "profit")


def n24_bottom10_agents(t: Portfolio) -> DataFrame:
    """SL-4: the 10 least profitable agents."""
    a = agent_performance(t).orderBy(F.col("profit").asc_nulls_last(), *AGENT_KEYS).limit(10)
    a = a.select(*AGENT_KEYS, "nb_contrats", "primes", "sinistres", "profit", "lr_pct")
    return _money_out(a, "primes", "sinistres", "profit")


def n25_agents_claims_without_premium(t: Portfolio) -> DataFrame:
    """DQ-12: agents whose portfolio has accepted claims but no premium."""
    a = agent_performance(t).filter((F.col("primes") == 0) & (F.col("sinistres") > 0))
    return _money_out(a, "primes", "sinistres", "profit")


def n25b_agent_lookup(t: Portfolio, agent_id: int = 127) -> DataFrame:
    """FLT-8: the key-lookup form of the same check."""
    a = agent_performance(t).filter(F.col("agent_id") == agent_id)
    return _money_out(a, "primes", "sinistres", "profit")


def n26_experience_profit_corr(t: Portfolio) -> DataFrame:
    """AG-15: Pearson correlation of agent experience and agent profit."""
    g = agent_rollup(t)
    return g.agg(
        round_even(F.corr(dbl(F.col("experience_years")), dbl(F.col("profit"))), 3).alias(
            "corr_experience_profit"
        )
    )


QUERIES = {
    "n01_audit": n01_audit,
    "n01b_null_columns": n01b_null_columns,
    "n01c_table_preview": n01c_table_preview,
    "n02_categories": n02_categories,
    "n03_inverted_contracts": n03_inverted_contracts,
    "n04_clients_without_policy": n04_clients_without_policy,
    "n04b_clients_without_policy_count": n04b_clients_without_policy_count,
    "n05_date_summary": n05_date_summary,
    "n06_premiums_agg": n06_premiums_agg,
    "n07_claims_all": n07_claims_all,
    "n08_claims_accepted": n08_claims_accepted,
    "n09_master": n09_master,
    "n09b_master_preview": n09b_master_preview,
    "n10_global_kpis": n10_global_kpis,
    "n11_product": n11_product,
    "n12_country": n12_country,
    "n13_country_product_mean_lr": n13_country_product_mean_lr,
    "n13b_country_product_pivot": n13b_country_product_pivot,
    "n14_yearly": n14_yearly,
    "n15_risk_by_product": n15_risk_by_product,
    "n16_claim_amount_describe": n16_claim_amount_describe,
    "n17_client_clv": n17_client_clv,
    "n18_clv_segments": n18_clv_segments,
    "n19_clv_concentration": n19_clv_concentration,
    "n20_top10_clients": n20_top10_clients,
    "n21_bottom10_clients": n21_bottom10_clients,
    "n22_agent_performance": n22_agent_performance,
    "n23_top10_agents": n23_top10_agents,
    "n24_bottom10_agents": n24_bottom10_agents,
    "n25_agents_claims_without_premium": n25_agents_claims_without_premium,
    "n25b_agent_lookup": n25b_agent_lookup,
    "n26_experience_profit_corr": n26_experience_profit_corr,
}
