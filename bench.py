"""Benchmark: run every named query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is built from scratch (no cache shared between queries) and
executed completely with the ``noop`` sink, so the time covers scanning,
shuffles and the final result without collecting it on the driver.  The
extra ``full_report_seconds`` times the whole analysis run together with
the master materialised once.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lossgrid.plans.registry import QUERIES  # noqa: E402
from lossgrid.plans.report import write_report  # noqa: E402
from lossgrid.session import local_session  # noqa: E402
from lossgrid.sources.testmap import mapped_portfolio  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(QUERIES)
    spark = local_session(cpus=cpus, shuffle_partitions=cpus)

    # The five tables as lazy plans over the parquet files (nothing is read
    # or cached here; every query below plans and scans from the files).
    t = mapped_portfolio(spark, sf_dir)

    # Warm the JVM (class loading, codegen caches) once; not timed.
    QUERIES["n11_product"](t).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](t).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    # The whole analysis in one run with the master materialised once.
    t0 = time.perf_counter()
    write_report(t, None)
    report_seconds = round(time.perf_counter() - t0, 3)

    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "full_report_seconds": report_seconds,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
