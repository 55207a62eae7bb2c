"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full through the ``noop`` sink (every row computed, nothing
collected to the driver). One warm-up query runs first so JVM start-up is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlens.plans.catalog import QUERIES  # noqa: E402
from wardlens.session import get_session  # noqa: E402

HEADLINE = [
    "aki", "proc_obs_extract", "analysis_table", "table_one", "pivot_count_rooms", "interp_asof",
    "interp_forward", "dose_auc", "o2_content", "do2", "vo2", "cardiac_power", "rvswi", "metric_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    QUERIES["aki"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
