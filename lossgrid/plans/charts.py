"""Chart datasets v01 .. v08: the rows behind each figure (drawing not built).

They reuse the master-track rollups; every one is a group-by over a bounded
key (product, country, year, agent) or a histogram with a fixed number of
bins, so results stay small whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text
from ..functions.metrics import dbl, ieee_ratio, ratio_or, round_even
from ..functions.ordering import pandas_asc
from ..operators.histogram import equal_width_histogram
from ..operators.master import policy_facts
from ..operators.rollup import weighted_rollup
from ..sources.readers import Portfolio
from .master_track import AGENT_KEYS, _keys_present, agent_rollup

HISTOGRAM_BINS = 60


def v01_gauge(t: Portfolio) -> DataFrame:
    """Global loss ratio, its distance to 100 and its band."""
    g = policy_facts(t, need=()).agg(
        F.sum("total_claim_accepted").alias("sin"), F.sum("total_premium").alias("ca")
    )
    lr = round_even(ieee_ratio(F.col("sin"), F.col("ca"), 100.0), 1)
    return g.select(lr.alias("lr")).select(
        "lr",
        (F.col("lr") - F.lit(100.0)).alias("delta"),
        L.lr_zone(F.col("lr")).alias("band"),
    )


def _rollup_by(t: Portfolio, key: str) -> DataFrame:
    return (
        _keys_present(policy_facts(t, need=("clients",) if key == "country" else ()), key)
        .groupBy(key)
        .agg(
            F.sum("total_premium").alias("primes"),
            F.sum("total_claim_accepted").alias("sinistres"),
            F.sum("profit").alias("profit"),
        )
    )


def v02_profit_by_product(t: Portfolio) -> DataFrame:
    """Profit by product with an LR label (profit ascending)."""
    g = _rollup_by(t, "product_type")
    lr = round_even(ieee_ratio(F.col("sinistres"), F.col("primes"), 100.0), 1)
    out = g.select(
        "product_type",
        dbl(F.col("primes")).alias("primes"),
        dbl(F.col("sinistres")).alias("sinistres"),
        dbl(F.col("primes") - F.col("sinistres")).alias("profit"),
        lr.alias("lr_pct"),
    ).withColumn("label", F.concat(F.lit("LR: "), text.float_str(F.col("lr_pct")), F.lit("%")))
    return out.orderBy(F.col("profit").asc_nulls_last(), "product_type")


def v03_country_bands(t: Portfolio) -> DataFrame:
    """Loss ratio by country with colour band and label (LR ascending, NaN last)."""
    g = _rollup_by(t, "country")
    lr = round_even(ieee_ratio(F.col("sinistres"), F.col("primes"), 100.0), 1)
    out = g.select(
        "country",
        dbl(F.col("primes")).alias("primes"),
        dbl(F.col("sinistres")).alias("sinistres"),
        dbl(F.col("profit")).alias("profit"),
        lr.alias("lr_pct"),
    )
    out = out.select(
        "*",
        L.country_band(F.col("lr_pct")).alias("band_color"),
        F.concat(
            text.float_str(F.col("lr_pct")),
            F.lit("%  |  Perte: "),
            text.grouped0(F.abs(F.col("profit"))),
        ).alias("label"),
    )
    return out.orderBy(*pandas_asc(F.col("lr_pct")), "country")


def v04_trend(t: Portfolio) -> DataFrame:
    """Premiums, claims and loss ratio by start year with their labels."""
    g = _rollup_by(t, "annee_debut")
    lr = round_even(ieee_ratio(F.col("sinistres"), F.col("primes"), 100.0), 1)
    out = g.select(
        "annee_debut",
        dbl(F.col("primes")).alias("primes"),
        dbl(F.col("sinistres")).alias("sinistres"),
        lr.alias("lr_pct"),
    )
    out = out.select(
        "*",
        F.concat(text.fixed0(F.col("primes") / F.lit(1000.0)), F.lit("k")).alias("label_primes"),
        F.concat(F.lit("LR:"), text.fixed0(F.col("lr_pct")), F.lit("%")).alias("label_lr"),
    )
    return out.orderBy("annee_debut")


def _agent_scatter(t: Portfolio) -> DataFrame:
    g = agent_rollup(t)
    return g.select(
        *AGENT_KEYS,
        F.col("nb_contrats").alias("nb"),
        dbl(F.col("primes")).alias("primes"),
        dbl(F.col("sinistres")).alias("sin"),
        F.col("profit").alias("profit_dec"),
        dbl(F.col("profit")).alias("profit"),
        round_even(ratio_or(F.col("sinistres"), F.col("primes"), None, 100.0), 1).alias("lr_pct"),
        L.agent_status(F.col("profit")).alias("statut"),
    )


V05_COLUMNS = (*AGENT_KEYS, "nb", "primes", "sin", "profit", "lr_pct", "statut")


def v05_agent_scatter(t: Portfolio) -> DataFrame:
    """Per-agent volume, profit, loss ratio (NULL without premium) and status."""
    return _agent_scatter(t).select(*V05_COLUMNS)


def v06_top_bottom_agents(t: Portfolio, k: int = 10) -> DataFrame:
    """SO-1: bottom k and top k agents by profit, stacked (an agent may be in both)."""
    s = _agent_scatter(t)
    bottom = (
        s.orderBy(F.col("profit_dec").asc_nulls_last(), *AGENT_KEYS)
        .limit(k)
        .withColumn("groupe", F.lit(L.BOTTOM_GROUP))
    )
    top = (
        s.orderBy(F.col("profit_dec").desc_nulls_last(), *AGENT_KEYS)
        .limit(k)
        .withColumn("groupe", F.lit(L.TOP_GROUP))
    )
    both = bottom.unionByName(top)
    return both.select(
        *V05_COLUMNS,
        "groupe",
        text.agent_label(F.col("agent_id"), F.col("region"), F.col("experience_years")).alias("label"),
        L.profit_colour(F.col("profit_dec")).alias("couleur"),
        text.signed0(F.col("profit")).alias("profit_text"),
    )


def _lr_of_priced_contracts(t: Portfolio) -> DataFrame:
    """FLT-4: loss ratio of contracts with a positive premium."""
    return policy_facts(t, need=()).filter(F.col("total_premium") > 0).select(F.col("loss_ratio").alias("lr"))


def v07_lr_histogram(t: Portfolio, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """AG-18: 60-bin histogram of the loss ratio of priced contracts, with zones."""
    h = equal_width_histogram(_lr_of_priced_contracts(t), "lr", bins)
    return h.withColumn("zone", L.lr_zone(F.col("lo")))


def v07b_lr_summary(t: Portfolio) -> DataFrame:
    """Counts on each side of 100 %, mean and max loss ratio of priced contracts, with the figure's texts."""
    lr = F.col("lr")
    out = _lr_of_priced_contracts(t).agg(
        F.count(lr).alias("n_contrats"),
        F.count_if(lr <= 100).alias("n_rentables"),
        F.count_if(lr > 100).alias("n_deficitaires"),
        round_even(F.avg(lr), 2).alias("lr_moyen"),
        F.max(lr).alias("lr_max"),
        F.avg(lr).alias("mean"),
    )

    def share(n: str):
        part = text.fixed0(ieee_ratio(F.col(n), F.col("n_contrats"), 100.0))
        return F.concat(F.col(n).cast("string"), F.lit(" ("), part, F.lit("%)"))

    return out.select(
        "n_contrats", "n_rentables", "n_deficitaires", "lr_moyen", "lr_max",
        share("n_rentables").alias("rentables_text"),
        share("n_deficitaires").alias("deficitaires_text"),
        F.concat(F.lit("Moy: "), text.fixed0(F.col("mean")), F.lit("%")).alias("moyenne_text"),
    )


def v08_portfolio_treemap(t: Portfolio) -> DataFrame:
    """AG-19: premium totals and LR by country and product with rollup levels."""
    leaf = (
        _keys_present(policy_facts(t, need=("clients",)), "country", "product_type")
        .groupBy("country", "product_type")
        .agg(
            F.sum("total_premium").alias("ca"),
            round_even(F.avg("loss_ratio"), 1).alias("lr"),
            F.count("policy_id").alias("nb"),
            F.sum("profit").alias("p"),
        )
    )
    r = weighted_rollup(leaf, ["country", "product_type"], value="ca", colour="lr",
                        sums=["nb", "p"])
    return r.select(
        "level",
        "country",
        "product_type",
        dbl(F.col("ca")).alias("ca"),
        round_even(F.col("lr"), 1).alias("lr"),
        "nb",
        dbl(F.col("p")).alias("p"),
    ).orderBy("level", F.col("country").asc_nulls_first(), F.col("product_type").asc_nulls_first())


QUERIES = {
    "v01_gauge": v01_gauge,
    "v02_profit_by_product": v02_profit_by_product,
    "v03_country_bands": v03_country_bands,
    "v04_trend": v04_trend,
    "v05_agent_scatter": v05_agent_scatter,
    "v06_top_bottom_agents": v06_top_bottom_agents,
    "v07_lr_histogram": v07_lr_histogram,
    "v07b_lr_summary": v07b_lr_summary,
    "v08_portfolio_treemap": v08_portfolio_treemap,
}
