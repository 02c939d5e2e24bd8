"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from tablecare.queries import QUERIES
from tablecare.session import local_session

HEADLINE = [
    "cohort_funnel", "cohort_funnel_by_entity", "group_share", "stats_by_group", "quantiles_by_group", "describe", "table1",
    "pooled_rank_entity", "top_frequency", "top_magnitude", "keep_one_last", "dedupe_rows", "anti_join", "lookup_join",
    "asof_join", "long_to_wide", "wide_to_long", "scan_findings", "apply_fixes_rows", "profile", "dataset_month",
    "crosstab_median", "histogram", "boxdot", "pareto", "welch_t", "chi_square", "value_candidates", "deidentify",
    "replay_steps", "report_cards",
]
RUNS = 2


def seconds(spark, folder: str, name: str) -> float:
    """The better of two runs; every row and column of the result is computed."""
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    times = {name: seconds(spark, folder, name) for name in HEADLINE}
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
