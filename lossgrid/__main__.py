"""Command line: run one named query or the whole analysis.

    python -m lossgrid --csv DIR --query n11_product          # show one result
    python -m lossgrid --csv DIR --out OUT [--format csv]     # write every result
    python -m lossgrid --mapped SF_DIR --out OUT              # from the test tables

Uses the active Spark configuration (``spark-submit`` or ``spark-defaults``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.registry import QUERIES
from .plans.report import write_report
from .session import RECOMMENDED_CONF
from .sources.readers import read_csv_portfolio, read_parquet_portfolio
from .sources.testmap import mapped_portfolio


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="lossgrid")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder with agents.csv, claims.csv, clients.csv, policies.csv, premiums.csv")
    src.add_argument("--parquet", help="folder with one Parquet dataset per table")
    src.add_argument("--mapped", help="folder with the TPC-H-like test tables")
    ap.add_argument("--lenient", action="store_true", help="read unreadable CSV fields as NULL; their rows go to OUT/rejected_rows")
    ap.add_argument("--narrow-ids", action="store_true", help="read ids as 32-bit integers")
    ap.add_argument("--query", choices=sorted(QUERIES), help="show one named result")
    ap.add_argument("--rows", type=int, default=50, help="rows to show with --query")
    ap.add_argument("--out", help="write every result under this folder")
    ap.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    args = ap.parse_args(argv)

    builder = SparkSession.builder.appName("lossgrid")
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()

    if args.csv:
        t = read_csv_portfolio(spark, args.csv, wide_ids=not args.narrow_ids, lenient=args.lenient)
    elif args.parquet:
        t = read_parquet_portfolio(spark, args.parquet, wide_ids=not args.narrow_ids)
    else:
        t = mapped_portfolio(spark, args.mapped)

    if args.query:
        QUERIES[args.query](t).show(args.rows, truncate=False)
    if args.out:
        for name, path in sorted(write_report(t, args.out, args.format).items()):
            print(f"{name}\t{path}")
    if not args.query and not args.out:
        ap.error("give --query and/or --out")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
