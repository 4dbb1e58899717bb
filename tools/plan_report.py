"""Summarize the executed (adaptive, final) plans of the headline reports.

Prints, per query: join strategies, shuffles, partial aggregates, window
group limits, and for every Parquet scan its pushed filters and read schema.
Usage: python tools/plan_report.py [sf_dir] > docs/PLANS.md
"""
import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from kpiloom.catalog.queries import QUERIES  # noqa: E402
from kpiloom.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
keys = ["report_visits_orders", "report_sales", "report_delivery", "topk_per_group", "sell_through",
        "report_new_users", "campaign_detail"]
WINDOW = r"Window \["
spark = build_session("local[8]", 8)
print(f"# Executed plans (final adaptive plans, {sf}, local[8])\n")
print("Generated by `python tools/plan_report.py`. Counts are operators in the final plan; "
      "`scans` lists each Parquet scan with the filters pushed into the reader and the columns read.\n")
for k in keys:
    df = QUERIES[k](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    df = QUERIES[k](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    cnt = lambda pat: len(re.findall(pat, final))
    print(f"## {k}\n")
    print(f"- BroadcastHashJoin: {cnt('BroadcastHashJoin')}, SortMergeJoin: {cnt('SortMergeJoin')}, "
          f"BroadcastNestedLoopJoin: {cnt('BroadcastNestedLoopJoin')}, CartesianProduct: {cnt('CartesianProduct')}")
    print(f"- shuffles (ShuffleQueryStage): {cnt('ShuffleQueryStage')}, reused exchanges: {cnt('ReusedExchange')}, "
          f"broadcasts: {cnt('BroadcastQueryStage')}")
    print(f"- partial aggregates: {cnt('partial_')} partial functions; "
          f"WindowGroupLimit: {cnt('WindowGroupLimit')}; Window: {cnt(WINDOW)}; Expand: {cnt('Expand ')}")
    seen = set()
    print("- scans:")
    for line in final.split("\n"):
        if "FileScan parquet" not in line:
            continue
        loc = re.search(r"Location: \w+\(\d+ paths\)\[([^\]]*)\]", line)
        pushed = re.search(r"PushedFilters: \[(.*?)\]?, ReadSchema", line)
        schema = re.search(r"ReadSchema: (\S+)", line)
        name = loc.group(1).rstrip("/").split("/")[-1] if loc else "?"
        key = (name, pushed and pushed.group(1), schema and schema.group(1))
        if key in seen:
            continue
        seen.add(key)
        print(f"  - `{name}` pushed=[{(pushed.group(1) if pushed else '')[:200]}] "
              f"read={(schema.group(1) if schema else '')[:200]}")
    print()
