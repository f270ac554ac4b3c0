"""Per-policy fact aggregates (AG-1) shared by both tracks.

Premiums and claims are reduced to one row per ``policy_id`` — the *premium
side* and the *claim side* — with one pass over each table.
``groupBy('policy_id')`` runs a map-side partial aggregation, so a policy
that owns a large share of all payments still sends one row per map task to
the shuffle, and the later joins on ``policy_id`` reuse this partitioning.

The master (fan-out free) reads the sides as totals.  The SQL statements
instead join premiums and accepted claims row by row, so a policy with k
premium rows and m accepted-claim rows yields k * max(m, 1) joined rows;
every aggregate they take over those rows is a weighted aggregate of the
same sides:

  SUM(pr.amount)        = sum_prem * max(m, 1)
  SUM(c.claim_amount)   = sum_claim * k          (NULL when no accepted claim)
  COUNT(c.claim_id)     = n_claim_ids * k
  AVG(c.claim_amount)   = SUM(c.claim_amount) / (n_claim_amounts * k)

so the pairs are never materialised and a hot policy cannot blow up a task.
A :class:`~lossgrid.sources.readers.Portfolio` may carry the two sides
precomputed (``with_sides``); the report runner does that once for all
queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import Portfolio
from ..sources.schemas import ACCEPTED


def zero_money():
    return F.lit(0).cast("decimal(10,2)")


def accepted(claims: DataFrame) -> DataFrame:
    """FLT-1: case-sensitive ``status = 'Accepted'``."""
    return claims.filter(F.col("status") == ACCEPTED)


def compute_premium_side(premiums: DataFrame) -> DataFrame:
    """``policy_id, n_prem_rows, sum_prem`` (sum NULL when every amount is NULL).

    The NULL policy id forms its own group (it never matches a join).
    """
    return premiums.groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("n_prem_rows"),
        F.sum("amount").alias("sum_prem"),
    )


def compute_claim_side(claims: DataFrame) -> DataFrame:
    """All-status totals and accepted-claim statistics per policy, one pass.

    ``total_claim, nb_claims`` over every status; ``sum_claim`` (NULL when no
    accepted amount), ``n_claim_ids`` (= accepted claim count),
    ``n_claim_rows``, ``n_claim_amounts`` over accepted claims only.
    """
    is_acc = F.col("status") == ACCEPTED
    return claims.groupBy("policy_id").agg(
        F.sum("claim_amount").alias("total_claim"),
        F.count("claim_id").alias("nb_claims"),
        F.sum(F.when(is_acc, F.col("claim_amount"))).alias("sum_claim"),
        F.count(F.when(is_acc, F.col("claim_id"))).alias("n_claim_ids"),
        F.count_if(is_acc).alias("n_claim_rows"),
        F.count(F.when(is_acc, F.col("claim_amount"))).alias("n_claim_amounts"),
    )


def premium_side(t: Portfolio) -> DataFrame:
    return t.premium_side if t.premium_side is not None else compute_premium_side(t.premiums)


def claim_side(t: Portfolio) -> DataFrame:
    return t.claim_side if t.claim_side is not None else compute_claim_side(t.claims)


def _keyed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("policy_id").isNotNull())


def premium_totals(t: Portfolio) -> DataFrame:
    """n06: ``policy_id, total_premium`` (0 when every amount is NULL); NULL ids dropped."""
    return _keyed(premium_side(t)).select(
        "policy_id", F.coalesce(F.col("sum_prem"), zero_money()).alias("total_premium")
    )


def claim_totals(t: Portfolio) -> DataFrame:
    """n07: all statuses -> ``policy_id, total_claim, nb_claims``."""
    return _keyed(claim_side(t)).select(
        "policy_id",
        F.coalesce(F.col("total_claim"), zero_money()).alias("total_claim"),
        "nb_claims",
    )


def accepted_claim_totals(t: Portfolio) -> DataFrame:
    """n08: policies with an accepted claim -> ``total_claim_accepted, nb_claims_accepted``."""
    return (
        _keyed(claim_side(t))
        .filter(F.col("n_claim_rows") > 0)
        .select(
            "policy_id",
            F.coalesce(F.col("sum_claim"), zero_money()).alias("total_claim_accepted"),
            F.col("n_claim_ids").alias("nb_claims_accepted"),
        )
    )


def weighted_fanout(left: DataFrame, t: Portfolio) -> DataFrame:
    """``left ⋈ premiums ⟕ accepted claims`` on policy_id, as weighted rows.

    Keeps the rows of ``left`` having at least one premium and adds
    ``w_prem_amount`` (their SUM(pr.amount) contribution), ``w_claim_amount``,
    ``w_claim_ids`` and ``w_claim_amounts``.
    """
    joined = left.join(premium_side(t), "policy_id", "inner").join(claim_side(t), "policy_id", "left")
    return joined.select(*left.columns, *fanout_weights(F.col("n_prem_rows")))


def fanout_weights(n_prem_rows):
    prem_mult = F.greatest(F.coalesce(F.col("n_claim_rows"), F.lit(0)), F.lit(1))
    return [
        (F.col("sum_prem") * prem_mult).alias("w_prem_amount"),
        (F.col("sum_claim") * n_prem_rows).alias("w_claim_amount"),
        (F.coalesce(F.col("n_claim_ids"), F.lit(0)) * n_prem_rows).alias("w_claim_ids"),
        (F.coalesce(F.col("n_claim_amounts"), F.lit(0)) * n_prem_rows).alias("w_claim_amounts"),
    ]
