"""Hand fixtures for the semantic traps (FIXTURES.md §3), literal expectations."""

from __future__ import annotations

import math

from lossgrid.functions import labels as L
from lossgrid.plans import charts, master_track as n, sql_track as s

AGENT = (1, "Kenya", 5)
CLIENT = (1, 40, "Kenya", "2019-01-01")


def rows(df):
    return [r.asDict() for r in df.collect()]


def one(df):
    out = rows(df)
    assert len(out) == 1, out
    return out[0]


def test_f1_fanout_sql_vs_master(portfolio):
    t = portfolio(
        agents=[AGENT],
        clients=[CLIENT],
        policies=[(1, 1, "Auto", "2021-01-01", "2022-01-01", 1)],
        premiums=[(1, 1, 100, "2021-01-05"), (2, 1, 50, "2021-02-05")],
        claims=[
            (1, 1, 10, "2021-03-01", "Accepted"),
            (2, 1, 20, "2021-04-01", "Accepted"),
            (3, 1, 30, "2021-05-01", "Accepted"),
        ],
    )
    r = one(s.s02_product_profitability(t))
    assert r["total_primes"] == 450.0 and r["total_sinistres"] == 120.0
    assert r["nb_polices"] == 1
    assert r["frequence_sinistralite"] == 6.0
    assert r["cout_moyen_sinistre"] == 20.0
    assert r["loss_ratio_pct"] == 26.67
    r = one(n.n11_product(t))
    assert r["primes"] == 150.0 and r["sinistres"] == 60.0 and r["nb_sinistres"] == 3
    assert r["loss_ratio_pct"] == 40.0 and r["cout_moyen"] == 20.0
    # the combined ratio fans out the same way (premiums x claims)
    r = one(s.s10_combined_ratio(t))
    assert r["loss_ratio_pct"] == 26.67
    assert r["combined_ratio_estime_pct"] == 51.67
    assert r["verdict"] == L.VERDICT_PROFIT


def test_f2_policy_without_premium(portfolio):
    t = portfolio(
        agents=[AGENT],
        clients=[CLIENT],
        policies=[(1, 1, "Auto", "2021-01-01", "2022-01-01", 1), (2, 1, "Vie", "2021-01-01", "2022-01-01", 1)],
        premiums=[(1, 2, 100, "2021-01-05")],
        claims=[(1, 1, 40, "2021-03-01", "Accepted")],
    )
    assert [r["product_type"] for r in rows(s.s02_product_profitability(t))] == ["Vie"]
    years = {r["annee"]: r for r in rows(s.s01_pnl_by_year(t))}
    assert years[2021]["total_sinistres"] == 40.0
    m = {r["policy_id"]: r for r in rows(n.n09_master(t))}
    assert m[1]["loss_ratio"] == 0.0 and m[1]["profit"] == -40.0 and m[1]["is_profitable"] is False
    assert m[2]["loss_ratio"] == 0.0 and m[2]["profit"] == 100.0 and m[2]["is_profitable"] is True


def test_f3_zero_premium_agent(portfolio):
    pols = [(i, 1, "Auto", "2021-01-01", "2022-01-01", 7) for i in (1, 2, 3)]
    t = portfolio(
        agents=[(7, "Nigeria", 9)],
        clients=[CLIENT],
        policies=pols,
        premiums=[(i, i, 0, "2021-01-05") for i in (1, 2, 3)],
        claims=[(i, i, 100, "2021-03-01", "Accepted") for i in (1, 2, 3)],
    )
    r = one(s.s08_underperforming_agents(t))
    assert r["loss_ratio_pct"] is None and r["niveau_alerte"] == L.AGENT_ALERT_ANOMALY
    r = one(n.n22_agent_performance(t))
    assert r["lr_pct"] == math.inf
    assert one(n.n25_agents_claims_without_premium(t))["agent_id"] == 7
    assert one(charts.v05_agent_scatter(t))["lr_pct"] is None


def test_f4_status_is_case_sensitive(portfolio):
    t = portfolio(
        claims=[
            (1, 1, 10, "2021-03-01", "Accepted"),
            (2, 1, 20, "2021-03-01", "accepted"),
            (3, 1, 30, "2021-03-01", "Rejected"),
            (4, 1, 40, "2021-03-01", None),
        ],
    )
    r = one(n.n08_claims_accepted(t))
    assert r["nb_claims_accepted"] == 1 and r["total_claim_accepted"] == 10.0
    r = one(n.n07_claims_all(t))
    assert r["nb_claims"] == 4 and r["total_claim"] == 100.0


def test_f5_f6_null_dates_and_one_sided_years(portfolio):
    t = portfolio(
        premiums=[(1, 1, 100, None), (2, 1, 80, "2020-05-01")],
        claims=[(1, 1, 40, None, "Accepted"), (2, 1, 70, "2021-05-01", "Accepted")],
    )
    by_year = {r["annee"]: r for r in rows(s.s01_pnl_by_year(t))}
    assert set(by_year) == {None, 2020, 2021}
    assert by_year[None]["signal"] == L.PNL_ANOMALY and by_year[None]["loss_ratio_pct"] is None
    assert by_year[None]["total_sinistres"] == 40.0 and by_year[None]["total_primes"] == 0.0
    assert by_year[2020]["signal"] == L.PNL_PROFITABLE and by_year[2020]["loss_ratio_pct"] == 0.0
    assert by_year[2021]["signal"] == L.PNL_ANOMALY and by_year[2021]["loss_ratio_pct"] is None


def test_f7_clv_segment_bounds(portfolio):
    clvs = {1: -1000, 2: 0, 3: 500, 4: 500.01}
    t = portfolio(
        clients=[(c, 30, "Kenya", "2019-01-01") for c in clvs],
        policies=[(c, c, "Auto", "2021-01-01", "2022-01-01", 1) for c in clvs],
        premiums=[(c, c, 1000 + v, "2021-01-05") for c, v in clvs.items()],
        claims=[(c, c, 1000, "2021-03-01", "Accepted") for c in clvs],
    )
    seg = {r["client_id"]: r["segment"] for r in rows(n.n17_client_clv(t))}
    assert seg == {1: "Très déficitaire", 2: "Déficitaire", 3: "Neutre", 4: "Profitable"}


def test_f8_strict_thresholds(portfolio):
    # yearly signal: LR exactly 100 and 200
    t = portfolio(
        premiums=[(1, 1, 100, "2020-01-01"), (2, 1, 100, "2021-01-01")],
        claims=[(1, 1, 100, "2020-02-01", "Accepted"), (2, 1, 200, "2021-02-01", "Accepted")],
    )
    sig = {r["annee"]: r["signal"] for r in rows(s.s01_pnl_by_year(t))}
    assert sig == {2020: L.PNL_PROFITABLE, 2021: L.PNL_DEFICIT}
    # agent alerts: LR exactly 200, 300, 500 (three policies per agent)
    lrs = {1: 200, 2: 300, 3: 500}
    pols, prem, clm = [], [], []
    for a, lr in lrs.items():
        for j in range(3):
            pid = a * 10 + j
            pols.append((pid, 1, "Auto", "2021-01-01", "2022-01-01", a))
            prem.append((pid, pid, 100, "2021-01-05"))
            clm.append((pid, pid, lr, "2021-03-01", "Accepted"))
    t = portfolio(
        agents=[(a, "Kenya", 3) for a in lrs], clients=[CLIENT], policies=pols, premiums=prem, claims=clm
    )
    alerts = {r["agent_id"]: r["niveau_alerte"] for r in rows(s.s08_underperforming_agents(t))}
    assert alerts == {2: L.AGENT_ALERT_HIGH, 3: L.AGENT_ALERT_SEVERE}


def test_f9_missing_dimension_rows(portfolio):
    t = portfolio(
        agents=[AGENT],
        clients=[CLIENT],
        policies=[
            (1, 1, "Auto", "2021-01-01", "2022-01-01", 1),
            (2, 99, "Auto", "2021-01-01", "2022-01-01", 98),
        ],
        premiums=[(1, 1, 100, "2021-01-05"), (2, 2, 100, "2021-01-05")],
    )
    m = {r["policy_id"]: r for r in rows(n.n09_master(t))}
    assert len(m) == 2 and m[2]["country"] is None and m[2]["region"] is None
    assert one(n.n12_country(t))["nb"] == 1
    assert one(n.n22_agent_performance(t))["nb_contrats"] == 1
    assert one(n.n11_product(t))["nb_contrats"] == 2


def test_f10_durations(portfolio):
    t = portfolio(
        policies=[
            (1, 1, "Auto", "2021-03-01", "2021-01-01", 1),
            (2, 1, "Auto", "2021-03-01", "2021-03-01", 1),
            (3, 1, "Auto", "2021-03-01", None, 1),
        ],
    )
    dur = {r["policy_id"]: r["duree_contrat_jours"] for r in rows(n.n09_master(t))}
    assert dur == {1: 59, 2: 0, 3: None}
    r = one(n.n03_inverted_contracts(t))
    assert (r["n_inverted"], r["n_total"], r["pct"]) == (1, 3, 33.3)


def test_f11_cohort_gap(portfolio):
    t = portfolio(
        policies=[
            (1, 1, "Auto", "2020-03-01", "2021-01-01", 1),
            (2, 1, "Auto", "2022-03-01", "2023-01-01", 1),
            (3, 2, "Auto", "2020-05-01", "2021-01-01", 1),
        ],
    )
    r = {(x["annee_cohorte"], x["annee_activite"]): x for x in rows(s.s07_cohort_retention(t))}
    assert r[(2020, 2020)]["clients_actifs"] == 2
    assert r[(2020, 2022)]["clients_annee_precedente"] == 2
    assert r[(2020, 2022)]["taux_retention_pct"] == 50.0
    assert r[(2020, 2022)]["annee_depuis_souscription"] == 2


def test_f12_duplicate_rows_with_nulls(portfolio):
    t = portfolio(agents=[(1, None, 3), (1, None, 3), (1, None, 3), (2, "Kenya", None)])
    audit = {r["column_name"]: r for r in rows(n.n01_audit(t)) if r["table_name"] == "agents"}
    assert audit["region"]["n_rows"] == 4 and audit["region"]["n_dup_rows"] == 2
    assert audit["region"]["n_nulls"] == 3 and audit["experience_years"]["n_nulls"] == 1
    assert audit["agent_id"]["data_type"] == "int"


def test_f13_topk_tie_break(portfolio):
    pols, prem = [], []
    for a in range(1, 13):
        pols.append((a, 1, "Auto", "2021-01-01", "2022-01-01", a))
        prem.append((a, a, 100 if a in (10, 11) else 50 if a == 12 else 200 + a, "2021-01-05"))
    t = portfolio(agents=[(a, "Kenya", 2) for a in range(1, 13)], clients=[CLIENT], policies=pols, premiums=prem)
    top = [r["agent_id"] for r in rows(n.n23_top10_agents(t))]
    assert top[-1] == 10 and 11 not in top
    top_sql = [r["agent_id"] for r in rows(s.s04_top_agents(t))]
    assert top_sql[-1] == 10 and 11 not in top_sql


def test_f14_product_without_accepted_claim(portfolio):
    t = portfolio(
        policies=[(1, 1, "Vie", "2021-01-01", "2022-01-01", 1)],
        premiums=[(1, 1, 100, "2021-01-05")],
        claims=[(1, 1, 50, "2021-02-01", "Rejected")],
    )
    assert one(s.s02_product_profitability(t))["total_sinistres"] == 0.0
    r = one(s.s06_frequency_severity(t))
    assert r["cout_total_sinistres"] is None and r["ratio_couverture"] is None
    assert one(n.n11_product(t))["cout_moyen"] == 0.0


def test_f15_fraction_sizes(portfolio):
    clvs = [-500, -300, -100, 0, 10, 20, 30, 40, 50, 60, 70]
    t = portfolio(
        clients=[(i, 30, "Kenya", "2019-01-01") for i in range(len(clvs))],
        policies=[(i, i, "Auto", "2021-01-01", "2022-01-01", 1) for i in range(len(clvs))],
        premiums=[(i, i, 1000 + v, "2021-01-05") for i, v in enumerate(clvs)],
        claims=[(i, i, 1000, "2021-02-01", "Accepted") for i in range(len(clvs))],
    )
    r = one(n.n19_clv_concentration(t))
    assert r["n_clients"] == 11 and r["n_rentables"] == 7
    assert r["top20_clv"] == 130.0  # int(11 * 0.2) = 2 -> 70 + 60
    assert r["top10_clv"] == 70.0 and r["bot10_clv"] == -500.0
    assert r["ratio_bot10_top10"] == round(500 / 70, 2)


def test_f17_metamorphic_tracks_agree(portfolio):
    pols, prem, clm = [], [], []
    for i in range(1, 9):
        pols.append((i, i % 3, "Auto" if i % 2 else "Vie", "2021-01-01", "2022-01-01", i % 4))
        prem.append((i, i, 100 + 7 * i, "2021-01-05"))
        if i % 3:
            clm.append((i, i, 40 * i, "2021-02-01", "Accepted"))
    t = portfolio(
        agents=[(a, "Kenya", 2) for a in range(4)],
        clients=[(c, 30, "Maroc", "2019-01-01") for c in range(3)],
        policies=pols,
        premiums=prem,
        claims=clm,
    )
    sql = {r["product_type"]: r for r in rows(s.s02_product_profitability(t))}
    df = {r["product_type"]: r for r in rows(n.n11_product(t))}
    for k in sql:
        assert sql[k]["total_primes"] == df[k]["primes"]
        assert sql[k]["total_sinistres"] == df[k]["sinistres"]
    sql = {r["country"]: r for r in rows(s.s03_country_performance(t))}
    df = {r["country"]: r for r in rows(n.n12_country(t))}
    assert sql["Maroc"]["total_primes"] == df["Maroc"]["primes"]
    # every policy has a premium here, so the agent top-10 agree as well
    sql = [(r["agent_id"], r["profit_net"], r["total_primes"]) for r in rows(s.s04_top_agents(t))]
    df = [(r["agent_id"], r["profit"], r["primes"]) for r in rows(n.n23_top10_agents(t))]
    assert sql == df


def test_f18_growth_first_year_null(portfolio):
    t = portfolio(
        policies=[(1, 1, "Auto", "2020-01-01", "2021-01-01", 1), (2, 1, "Auto", "2021-01-01", "2022-01-01", 1)],
        premiums=[(1, 1, 200, "2020-01-05"), (2, 2, 300, "2021-01-05")],
    )
    g = {r["annee_debut"]: r["croissance_pct"] for r in rows(n.n14_yearly(t))}
    assert g == {2020: None, 2021: 50.0}
