"""Typed schemas of the five portfolio tables and the fixed domain values.

Ids are ``int`` as declared by the source DDL; widen them to ``long`` with
:func:`widen_ids` when a deployment's key space needs it.  Money is always
``decimal(10,2)`` so sums stay exact; it is cast to ``double`` only when a
result is emitted.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

AGENTS = T.StructType(
    [
        T.StructField("agent_id", T.IntegerType()),
        T.StructField("region", T.StringType()),
        T.StructField("experience_years", T.IntegerType()),
    ]
)

CLAIMS = T.StructType(
    [
        T.StructField("claim_id", T.IntegerType()),
        T.StructField("policy_id", T.IntegerType()),
        T.StructField("claim_amount", MONEY),
        T.StructField("claim_date", T.DateType()),
        T.StructField("status", T.StringType()),
    ]
)

CLIENTS = T.StructType(
    [
        T.StructField("client_id", T.IntegerType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("country", T.StringType()),
        T.StructField("signup_date", T.DateType()),
    ]
)

POLICIES = T.StructType(
    [
        T.StructField("policy_id", T.IntegerType()),
        T.StructField("client_id", T.IntegerType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("agent_id", T.IntegerType()),
    ]
)

PREMIUMS = T.StructType(
    [
        T.StructField("premium_id", T.IntegerType()),
        T.StructField("policy_id", T.IntegerType()),
        T.StructField("amount", MONEY),
        T.StructField("payment_date", T.DateType()),
    ]
)

SCHEMAS: dict[str, T.StructType] = {
    "agents": AGENTS,
    "claims": CLAIMS,
    "clients": CLIENTS,
    "policies": POLICIES,
    "premiums": PREMIUMS,
}

TABLE_ORDER = ("agents", "claims", "clients", "policies", "premiums")

# --- Fixed values (must equal the source project's data and code) -----------
# Claim status that counts as paid; the comparison is case-sensitive.
ACCEPTED = "Accepted"
# Product lines, in alphabetical order (also the pivot column order).
PRODUCTS = ("Auto", "Habitation", "Santé", "Vie")
# Minimum number of policies before an agent is assessed (SQL track).
MIN_POLICIES_PER_AGENT = 3
# Estimated expense ratio in percent used by the combined ratio.
EXPENSE_RATIO_PCT = 25.0
# ----------------------------------------------------------------------------


def widen_ids(schema: T.StructType) -> T.StructType:
    """Same schema with every ``*_id`` column widened to ``long``."""
    return T.StructType(
        [
            T.StructField(f.name, T.LongType(), f.nullable)
            if f.name.endswith("_id")
            else f
            for f in schema.fields
        ]
    )
