"""Times the headline queries: one JSON line. BENCH_SF_DIR is the data, BENCH_CPUS the cores of one local session."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom.plans.queries import catalogue
from gridloom.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: Queries that stand beside published numbers: exact aggregates, segment joins and top-k, each raw and regional, and neighbours.
HEADLINES = [
    "gac_fdw_multiregion_event_exact_raw_summary",
    "gac_fdw_multiregion_event_exact_regional_summary",
    "gac_fdw_coordinator_local_user_join",
    "gac_fdw_coordinator_regional_user_join",
    "topk_raw_event_value_desc",
    "topk_regional_event_value_desc",
    "gac_fdw_multiregion_top_tenants",
    "sr_q08_multi_dimension_rollup",
    "count_join_tree_7",
    "agg_task_spread",
    "gain_summary",
    "nearest_euclidean",
    "fcm_memberships",
]


def main() -> None:
    spark = build_session(CPUS, shuffle_partitions=max(4, int(CPUS)))
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue()[0]
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        # The first run compiles and lists files.
        seconds[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
