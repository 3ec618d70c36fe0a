"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then the mean of two timed runs counts.
A run builds the query and consumes every row and column of its result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES
from shelfmark.session import local_session

HEADLINE = [
    "dedupe_plan",
    "dedupe_full_plan",
    "dedupe_incremental",
    "dedupe_stats",
    "dup_groups",
    "hash_full",
    "size_groups",
    "classify_case",
    "classify_join",
    "filter_ignore",
    "filter_ignore_join",
    "ignore_load",
    "rules_load",
    "top_largest",
    "walk_order",
    "plan_summary",
    "plan_apply",
    "dup_purge",
    "undo_plan",
    "rename_collisions",
    "normalize_names",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    seconds = {}
    for key in only:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[key] = round(statistics.mean(times[1:]), 3)
        print(key, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (mean of 2 warm runs each)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
