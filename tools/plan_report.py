"""Summarise the final (AQE) physical plan of queries after running them.

Usage: python tools/plan_report.py [sf_dir] [name ...]
Prints, per query: exchanges, join strategies, aggregate kinds, windows,
Python (Arrow) operators, and for every Parquet scan its columns and pushed
filters.  Executes each query once (into the ``noop`` sink) so AQE's final
plan is shown.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["leaderboard_ranked", "classify_clicks", "classify_clicks_b", "ownership_diff", "tile_country",
            "ownerships_by_range"]
NODES = ("Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate",
         "Window", "MapInArrow", "FlatMapGroupsInPandasWithState", "Generate", "TakeOrderedAndProject", "Sort")


def summarise(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    if "== Initial Plan ==" in text:  # AQE prints the final plan first
        text = text.split("== Initial Plan ==")[0]
    nodes = Counter()
    for line in text.splitlines():
        m = re.match(r"^[\s:+\-|*()0-9]*([A-Za-z]+)", line)
        if m and m.group(1) in NODES:
            nodes[m.group(1)] += 1
    scans = []
    for line in text.splitlines():
        if "FileScan parquet" in line:
            cols = re.search(r"FileScan parquet [^\[]*\[([^\]]*)\]", line)
            pushed = re.search(r"PushedFilters: \[(.*?)(\]|\.\.\.)", line)
            loc = re.search(r"Location: \w+\([^)]*\)\[([^\]]*)\]", line)
            table = os.path.basename(loc.group(1)) if loc else "?"
            colnames = [re.sub(r"#\d+L?$", "", c.strip()) for c in cols.group(1).split(",")] if cols else []
            scans.append(f"{table}: cols={colnames} pushed=[{pushed.group(1) if pushed else ''}]")
    out = ["  operators: " + ", ".join(f"{k} x{v}" for k, v in sorted(nodes.items()))]
    out += ["  scan " + s for s in sorted(set(scans))]
    return "\n".join(out)


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or HEADLINE
    from terrastate.plans import load_all
    from terrastate.session import build_session

    spark = build_session()
    queries = load_all()
    for name in names:
        print(f"{name}:")
        print(summarise(queries[name].build(spark, sf_dir)))


if __name__ == "__main__":
    main()
