"""Benchmark: headline catalogue queries at one scale factor.

usage: BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is built from the catalogue (the library plan, without the rounding applied for
the oracle comparison) and executed to completion with the ``noop`` sink (the whole plan runs,
nothing is collected to the driver).  Build time (including fit steps) is part of the figure.  Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "customer_mart",            # flagship: lines -> orders -> customers
    "mart_final",               # D1-D8 star join, one row per customer
    "mart_instalments",         # chunked sequence features per order
    "mart_slices",              # first/last-k, time slices, EWM
    "seq_diff_running_chunked",
    "ewm_mean",
    "agg_mixed_profile",
    "cond_agg_category",
    "join_composite",
    "dist_pack",
    "quantile_bins",
    "woe_numeric",
    "describe",
    "correlation_matrix",
    "one_hot",
    "auc_gini",
    "optimal_bins",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    from featmart.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="featmart-bench", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    from featmart.plans.catalog import RAW as qs
    names = only or HEADLINE
    # warm-up: JVM class loading and the parquet footers, not timed
    qs["filter_pack"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"# {n}: {times[n]:.2f}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
