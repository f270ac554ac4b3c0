"""The five portfolio tables derived from the TPC-H-like test tables.

``policies <- orders``, ``premiums <- lineitem (status O)``, ``claims <-
lineitem (status F)``, ``clients <- customer x 8``, ``agents <- part x 2``,
countries and regions from ``region``.  The DataFrame version below and the
SQL text :data:`MAPPED_VIEWS_SQL` (used by the DuckDB oracle) compute the
same rows.

Ids are ``bigint`` (the source keys multiplied by 8, 10 ... leave the
32-bit range at large scale factors); the other columns follow the fixed
schemas.  Every table grows linearly with its source table: the x8 / x2 replication is
an ``explode`` of a literal array, not a join, and the two lookups (``region``
and ``nation``) are dimension tables of fixed size that the planner
broadcasts from their file statistics.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import Portfolio

SIGNUP_EPOCH = dt.date(1995, 1, 1)


# Columns of the base tables this mapping reads.  Declaring them skips the
# footer-reading schema inference job per table and prunes every scan.
BASE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "part": "p_partkey BIGINT, p_size INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "lineitem": (
        "l_orderkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, l_returnflag STRING,"
        " l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _money(extended_price: Column, divisor: int) -> Column:
    cents = F.round(extended_price * 100)
    return (F.floor(cents / divisor) / 100).cast("decimal(10,2)")


def mapped_portfolio(spark: SparkSession, sf_dir: str) -> Portfolio:
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )
    lineitem = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    )

    agents = (
        part.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        .join(region, (F.col("p_partkey") % 5) == F.col("r_regionkey"))
        .select(
            (F.col("p_partkey") * 2 + F.col("k")).alias("agent_id"),
            F.col("r_name").alias("region"),
            (1 + (F.col("p_size") + F.col("k")) % 14).cast("int").alias("experience_years"),
        )
    )

    nation_region = nation.join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "r_name")
    clients = (
        customer.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
        .join(nation_region, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            (F.col("c_custkey") * 8 + F.col("k")).alias("client_id"),
            (18 + F.col("c_custkey") % 62).cast("int").alias("age"),
            F.col("r_name").alias("country"),
            F.date_add(
                F.lit(SIGNUP_EPOCH), (F.col("c_custkey") % 2400).cast("int")
            ).alias("signup_date"),
        )
    )

    n_agents = part.select(F.count(F.lit(1)) * 2).scalar()
    product_slot = F.floor(F.col("o_orderkey") / 4) % 4
    start = F.col("o_orderdate").cast("date")
    policies = orders.select(
        F.col("o_orderkey").alias("policy_id"),
        (F.col("o_custkey") * 8 + 2 * (F.col("o_orderkey") % 4)).alias("client_id"),
        F.when(product_slot == 0, "Auto")
        .when(product_slot == 1, "Santé")
        .when(product_slot == 2, "Habitation")
        .otherwise("Vie")
        .alias("product_type"),
        start.alias("start_date"),
        F.date_add(start, (F.col("o_orderkey") % 900 - 300).cast("int")).alias("end_date"),
        (F.round(F.col("o_totalprice") * 100).cast("long") % n_agents).alias("agent_id"),
    )

    line_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    premiums = lineitem.filter(F.col("l_linestatus") == "O").select(
        line_id.alias("premium_id"),
        F.col("l_orderkey").alias("policy_id"),
        _money(F.col("l_extendedprice"), 50).alias("amount"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(None).cast("date"))
        .otherwise(F.col("l_shipdate").cast("date"))
        .alias("payment_date"),
    )
    claims = lineitem.filter(F.col("l_linestatus") == "F").select(
        line_id.alias("claim_id"),
        F.col("l_orderkey").alias("policy_id"),
        _money(F.col("l_extendedprice"), 18).alias("claim_amount"),
        F.when(F.col("l_orderkey") % 101 == 0, F.lit(None).cast("date"))
        .otherwise(F.col("l_shipdate").cast("date"))
        .alias("claim_date"),
        F.when(F.col("l_returnflag") == "R", "Rejected").otherwise("Accepted").alias("status"),
    )
    # Ids are made from the primary keys of customer and part, so each occurs once.
    return Portfolio(
        agents=agents, claims=claims, clients=clients, policies=policies, premiums=premiums
    ).with_unique({"clients", "agents"})


# The same five tables as SQL common table expressions over the base tables
# (region nation customer part orders lineitem); used as the prefix of every
# oracle query.
MAPPED_VIEWS_SQL = """
agents AS (
  SELECT CAST(p.p_partkey * 2 + k.k AS BIGINT) AS agent_id, r.r_name AS region,
         CAST(1 + (p.p_size + k.k) % 14 AS INT) AS experience_years
  FROM part p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) k
  JOIN region r ON r.r_regionkey = p.p_partkey % 5
),
clients AS (
  SELECT CAST(c.c_custkey * 8 + k.k AS BIGINT) AS client_id, CAST(18 + c.c_custkey % 62 AS INT) AS age,
         r.r_name AS country, DATE '1995-01-01' + CAST(c.c_custkey % 2400 AS INT) AS signup_date
  FROM customer c
  CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3
              UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) k
  JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
),
policies AS (
  SELECT CAST(o_orderkey AS BIGINT) AS policy_id, CAST(o_custkey * 8 + 2 * (o_orderkey % 4) AS BIGINT) AS client_id,
         CASE CAST(FLOOR(o_orderkey / 4) AS BIGINT) % 4 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Santé'
              WHEN 2 THEN 'Habitation' ELSE 'Vie' END AS product_type,
         CAST(o_orderdate AS DATE) AS start_date,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 - 300 AS INT) AS end_date,
         CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % (2 * (SELECT COUNT(*) FROM part)) AS BIGINT) AS agent_id
  FROM orders
),
premiums AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS premium_id, CAST(l_orderkey AS BIGINT) AS policy_id,
         CAST(FLOOR(ROUND(l_extendedprice * 100) / 50) / 100 AS DECIMAL(10,2)) AS amount,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS payment_date
  FROM lineitem WHERE l_linestatus = 'O'
),
claims AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS claim_id, CAST(l_orderkey AS BIGINT) AS policy_id,
         CAST(FLOOR(ROUND(l_extendedprice * 100) / 18) / 100 AS DECIMAL(10,2)) AS claim_amount,
         CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS claim_date,
         CASE l_returnflag WHEN 'R' THEN 'Rejected' ELSE 'Accepted' END AS status
  FROM lineitem WHERE l_linestatus = 'F'
)
"""


def with_views(body: str) -> str:
    """Prefix an SQL body with the five mapped tables as CTEs.

    ``body`` may start with its own ``WITH``; its CTEs are appended.
    """
    text = body.strip()
    if text[:4].upper() == "WITH":
        return "WITH " + MAPPED_VIEWS_SQL.strip() + ",\n" + text[4:].lstrip()
    return "WITH " + MAPPED_VIEWS_SQL.strip() + "\n" + text
