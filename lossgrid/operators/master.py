"""The master table: one row per policy with its facts (JN-1, JN-8, PRJ-1..7).

:func:`policy_facts` keeps money as exact DECIMAL for the group-bys built on
it; :func:`master` is the 23-column export with money as DOUBLE.

Plan shape: premiums and claims are aggregated per policy (the two fact
sides of :mod:`lossgrid.operators.facts`; partial + final hash aggregate,
one shuffle each), policies is shuffled once on ``policy_id`` and both fact
joins reuse that partitioning.  Clients and agents are joined only where
their columns are read: AQE broadcasts them when their measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a sort-merge
join.  Rollups by client or agent aggregate by that key first (with map-side
combining) and meet the dimension with one row per key, so a key that holds a
third of all policies never gathers its policies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import div
from ..sources.readers import Portfolio
from .facts import claim_side, premium_side, zero_money
from .flags import flag_words, with_flag

MASTER_COLUMNS = (
    "policy_id", "client_id", "product_type", "start_date", "end_date",
    "agent_id", "region", "experience_years",
    "age", "country", "signup_date", "annee_signup",
    "total_premium", "total_claim", "total_claim_accepted",
    "nb_claims", "nb_claims_accepted",
    "loss_ratio", "profit", "is_profitable",
    "duree_contrat_jours", "annee_debut", "mois_debut",
)

MONEY_COLUMNS = ("total_premium", "total_claim", "total_claim_accepted", "profit")


DIMENSIONS = {"clients": "client_id", "agents": "agent_id"}


def repeated_keys(t: Portfolio, name: str) -> DataFrame:
    """``_key, _copies`` of the keys that dimension ``name`` holds more than once."""
    rows = getattr(t, name).groupBy(F.col(DIMENSIONS[name]).alias("_key"))
    return rows.agg(F.count(F.lit(1)).cast("int").alias("_copies")).filter(F.col("_copies") > 1)


def verified(t: Portfolio) -> Portfolio:
    """``t`` with the dimensions whose keys are found unique marked so (one job for each not yet marked)."""
    found = {name for name in DIMENSIONS if name not in t.unique and repeated_keys(t, name).isEmpty()}
    return t.with_unique(t.unique | found)


def _hash(key: Column) -> Column:
    return F.xxhash64(key.isNull(), key)


def with_copies(rows: DataFrame, t: Portfolio, name: str) -> DataFrame:
    """``rows``, each as often as dimension ``name`` holds its key (once if it does not).

    A left join to a dimension repeats a policy once for each row of its key,
    so a rollup that reads no column of the dimension needs only these counts.
    Where the keys are known to be unique there is nothing to do.  Otherwise
    the plan itself finds the repeated keys: they go to the tasks as a bounded
    set of flags, and only the rows flagged are dealt out to meet their number.
    """
    if name in t.unique:
        return rows
    key, copies = F.col(DIMENSIONS[name]), repeated_keys(t, name)
    words = flag_words(copies.select(_hash(F.col("_key")).alias("_hash")), "_hash")
    marked = with_flag(rows, _hash(key), words)
    once, some = (marked.where(c).drop("_flagged") for c in ("not _flagged", "_flagged"))
    some = some.join(copies, key.eqNullSafe(F.col("_key")), "left")
    times = F.explode(F.array_repeat(F.lit(0), F.coalesce("_copies", F.lit(1))))
    return once.union(some.withColumn("_copy", times).select(once.columns))


def join_dimension(rows: DataFrame, t: Portfolio, name: str) -> DataFrame:
    """Left join to a dimension; a NULL key meets a NULL key, as a data-frame merge has it."""
    key = DIMENSIONS[name]
    dim = getattr(t, name).withColumnRenamed(key, "_key")
    return rows.join(dim, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def priced_policies(t: Portfolio) -> DataFrame:
    """Policies with the totals of their premiums and claims, each row once whatever the dimensions hold."""
    return t.priced if t.priced is not None else _priced(t.policies, t)


def _priced(policies: DataFrame, t: Portfolio) -> DataFrame:
    prem_side = premium_side(t).select("policy_id", "sum_prem")
    clm_side = claim_side(t).select("policy_id", "total_claim", "nb_claims", "sum_claim", "n_claim_ids")
    return policies.join(prem_side, "policy_id", "left").join(clm_side, "policy_id", "left")


def policy_facts(t: Portfolio, need: tuple[str, ...] = ("clients", "agents"), later: tuple[str, ...] = ()) -> DataFrame:
    """Master rows with DECIMAL money (internal form used by every rollup).

    ``need`` names the dimensions whose columns are read; only they are
    joined.  Of the others only the number of rows of a policy's key matters,
    and they are not joined at all when their keys are unique.  Dimensions in
    ``later`` are left to the caller, who joins them after grouping by key.
    """
    if t.facts is not None:
        return t.facts
    facts = t.policies if t.priced is None else t.priced
    for name in DIMENSIONS:
        if name not in need and name not in later:
            facts = with_copies(facts, t, name)
    if t.priced is None:
        facts = _priced(facts, t)
    for name in DIMENSIONS:
        if name in need:
            facts = join_dimension(facts, t, name)
    prem = F.coalesce(F.col("sum_prem"), zero_money())
    acc = F.coalesce(F.col("sum_claim"), zero_money())
    profit = prem - acc
    agent = ["region", "experience_years"] if "agents" in need else []
    client = ["age", "country", "signup_date", F.year("signup_date").alias("annee_signup")] if "clients" in need else []
    return facts.select(
        "policy_id", "client_id", "product_type", "start_date", "end_date",
        "agent_id", *agent, *client,
        prem.alias("total_premium"),
        F.coalesce(F.col("total_claim"), zero_money()).alias("total_claim"),
        acc.alias("total_claim_accepted"),
        F.coalesce(F.col("nb_claims"), F.lit(0)).cast("long").alias("nb_claims"),
        F.coalesce(F.col("n_claim_ids"), F.lit(0)).cast("long").alias("nb_claims_accepted"),
        F.when(prem > 0, div(acc, prem, 100.0)).otherwise(F.lit(0.0)).alias("loss_ratio"),
        profit.alias("profit"),
        (profit > 0).alias("is_profitable"),
        F.abs(F.datediff("end_date", "start_date")).alias("duree_contrat_jours"),
        F.year("start_date").alias("annee_debut"),
        F.month("start_date").alias("mois_debut"),
    )


def master(t: Portfolio) -> DataFrame:
    """n09: the 23-column master table, money as DOUBLE."""
    facts = policy_facts(t)
    return facts.select(
        *[
            F.col(c).cast("double").alias(c) if c in MONEY_COLUMNS else F.col(c)
            for c in MASTER_COLUMNS
        ]
    )
