"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints one JSON line.  Each query is executed to
completion into the ``noop`` sink (no driver collect): one warm-up round over
all queries, then the best of $BENCH_REPEATS timed runs (plan building included).
"""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
warnings.filterwarnings("ignore")

HEADLINE = ["leaderboard_ranked", "classify_clicks", "classify_clicks_b", "ownership_diff", "tile_country"]
SERVED = "leaderboard_served"  # the read path: leaderboard over the maintained ownership snapshot (K1)


def served_builder(spark, sf_dir):
    """Writes the ownership snapshot of ``clicks_b`` once (untimed, as the K1
    sink keeps it) and returns a builder of the leaderboard read over it."""
    from terrastate.operators.leaderboard import leaderboard_ranked
    from terrastate.operators.ownership import current_ownership
    from terrastate.session import scratch_path
    from terrastate.sinks.versions import SnapshotStore
    from terrastate.sources import derived as d

    store = SnapshotStore(spark, scratch_path(spark, "bench-snapshot"))
    store.add(current_ownership(d.clicks_b(spark, sf_dir)))
    return lambda _spark, _sf: leaderboard_ranked(store.read())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE

    from terrastate.plans import load_all
    from terrastate.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    builders = {name: q.build for name, q in load_all().items()}
    if not sys.argv[1:]:
        names = names + [SERVED]
    if SERVED in names:
        builders[SERVED] = served_builder(spark, sf_dir)
    times: dict[str, float] = {}
    for name in names:  # warm-up of the JVM (codegen, class loading) for every query first
        builders[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        build = builders[name]
        best = float("inf")
        for _ in range(repeats):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
