"""Time the headline queries on one machine and print one JSON line.

Each query runs once to warm up (code generation, file listing) and then BENCH_RUNS times;
the median is reported. Results are written to a no-op sink, so every row is produced.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyline.plans import registry
from tallyline.session import build_session

HEADLINE = (
    "totals_range",
    "groups_models",
    "groups_projects",
    "series_utc_days",
    "series_kathmandu_hours",
    "heatmap_levels",
    "pricing_by_currency",
    "priced_events",
    "sessions_totals",
    "turns_totals",
    "events_page_by_time",
    "facet_sources",
    "hybrid_totals",
    "answer_header",
    "answer_sessions_page",
    "rollup_cohorts",
    "log_observations",
    "accounting_single_streams",
    "copies_canonical_plan",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = sys.argv[1:]
    spark = build_session(
        "tallyline-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    timings: dict[str, float] = {}
    for name in only or HEADLINE:
        query = registry.QUERIES[name]
        taken = []
        for n in range(runs + 1):
            start = time.perf_counter()
            query(spark, directory).write.format("noop").mode("overwrite").save()
            if n:
                taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken), 3)
        print(f"{name} {timings[name]}", file=sys.stderr)
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    result = {"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": float(scale)}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
