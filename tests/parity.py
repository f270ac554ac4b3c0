"""Spark-vs-DuckDB parity check for the named queries.

Runs a query through Spark and its oracle SQL through DuckDB over the same
parquet files and compares column names, column types, row count and the
multiset of rows (exact values; NaN equals NaN).  Usable from pytest and as
``python tests/parity.py <sf_dir> [query ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
from collections import Counter

import duckdb

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DUCK_TO_SPARK = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", v.normalize())
    if isinstance(v, dt.datetime):
        return ("ts", v.isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    return v


def _key(row):
    return tuple(repr(x) for x in row)


def compare(spark, con, name: str, sf_dir: str, query_fn, sql: str) -> list[str]:
    """Return a list of problems (empty when Spark and the oracle agree).

    The oracle must also be a statement that can be stored as a view.
    """
    con.execute(f"CREATE OR REPLACE VIEW oracle_of_query AS {sql}")
    return compare_frames(query_fn(spark, sf_dir), con, sql)


def compare_frames(sdf, con, sql: str) -> list[str]:
    """Compare a Spark DataFrame with the result of ``sql`` on ``con``."""
    s_cols = sdf.columns
    s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
    s_rows = [tuple(_norm(v) for v in r) for r in sdf.collect()]

    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]

    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={s_cols} duck={d_cols}")
        return problems
    for c, st in zip(s_cols, s_types):
        dtype = d_types[d_cols.index(c)]
        mapped = DUCK_TO_SPARK.get(dtype, dtype.lower())
        if mapped != st and not (st.startswith("decimal") and dtype.startswith("DECIMAL")):
            problems.append(f"type of {c}: spark={st} duck={dtype}")
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark={len(s_rows)} duck={len(d_rows)}")
    cs, cd = Counter(map(_key, s_rows)), Counter(map(_key, d_rows))
    if cs != cd:
        only_s = list((cs - cd).elements())[:5]
        only_d = list((cd - cs).elements())[:5]
        problems.append(
            f"values differ ({sum((cs - cd).values())} spark-only rows); "
            f"cols={s_cols}\n   spark-only: {only_s}\n   duck-only:  {only_d}"
        )
    return problems


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lossgrid.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    con = duck_connection(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        if name not in oracle:
            print(f"{name}: (no oracle)")
            continue
        try:
            problems = compare(spark, con, name, sf_dir, queries[name], oracle[name])
        except Exception as e:  # noqa: BLE001
            problems = [f"ERROR {type(e).__name__}: {str(e)[:800]}"]
        print(f"{name}: {'OK' if not problems else 'FAIL'}")
        for p in problems:
            print("   ", p)
        bad += bool(problems)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
