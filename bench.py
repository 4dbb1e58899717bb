"""Benchmark the headline reports.

Runs each report query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": "reports_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``
(plus ``cpus``; ``spark_jobs``: Spark jobs per report, from the status tracker; ``cold``: seconds
of each report as the first of a new run, dimension snapshots included, and ``cold_total_sec``).

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver). One untimed warm-up pass runs first (JIT,
file listing caches). Then each report is timed cold, with nothing kept from an
earlier run, and warm, with the dimension snapshots of its run in place (as in a
daily run, which writes them once): the best of ``$BENCH_REPEAT`` runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "report_new_users",       # table1
    "report_visits_orders",   # table2
    "report_sales",           # table3
    "report_delivery",        # table4
    "topk_per_group",         # top products
    "channel_counts",         # orders / buyers per channel
    "sell_through",           # sell-through rate
    "sales_detail",           # 7-day detail export
    "campaign_detail",        # campaign export
    "campaign_summary",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from kpiloom.catalog.queries import QUERIES, fresh_run
    from kpiloom.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})
    for name in HEADLINE:                        # warm-up
        run(QUERIES[name](spark, sf_dir))
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    times, cold, jobs = {}, {}, {}
    for name in HEADLINE:
        fresh_run()
        t0 = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        cold[name] = round(time.perf_counter() - t0, 3)
        best = None
        for i in range(repeat):
            group = f"bench-{name}-{i}"
            sc.setJobGroup(group, name)
            t0 = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
            jobs[name] = len(tracker.getJobIdsForGroup(group))
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "reports_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "spark_jobs": jobs, "cold": cold,
                      "cold_total_sec": round(sum(cold.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
