"""Headline queries over one scale factor; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from commutelens.plans.queries import QUERIES  # noqa: E402
from commutelens.session import build_session, scratch  # noqa: E402

HEADLINE = [
    "accessibility",
    "sigma_fanout",
    "critical_population",
    "performance_row",
    "critical_by_decile",
    "lorenz_curve",
    "gini_severity",
    "boxplot_stats_weighted",
    "weighted_histogram_sigma",
    "poverty_curve",
    "od_join_ttm",
    "ttm_diff",
    "feed_filter_time",
    "fleet_by_hour",
    "dist_by_trip",
    "loo_fleet",
    "greedy_fill",
    "candidate_cost",
    "ttm_timetable",
]
# these search the timetable for many candidates or for two feeds: only with BENCH_ROUTED=1, and reported apart
ROUTED = ["candidate_fitness", "scenario_run"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", shuffle_partitions=int(cpus), **{"spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed run so that JVM start and code generation are not billed to the first query
    QUERIES["accessibility"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    routed = ROUTED if os.environ.get("BENCH_ROUTED") == "1" else []
    for name in HEADLINE + routed:
        start = time.perf_counter()
        with scratch(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds[n] for n in HEADLINE), 3),
                "routed": round(sum(seconds[n] for n in routed), 3) if routed else None,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
