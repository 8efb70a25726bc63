"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Each query runs once to warm
up and then BENCH_RUNS times into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyline.plans.catalog import QUERIES  # noqa: E402
from tallyline.session import build_session  # noqa: E402

HEADLINE = [
    "product_day",
    "typed_rows",
    "contributions",
    "nested_contributions",
    "independent_recompute",
    "reconcile_differences",
    "land_twice",
    "scope_ids",
    "compare_groups",
    "run_states",
    "event_validity",
    "dispositions",
    "delivery_attempts",
    "ledger_product_day",
    "position_gaps",
    "late_day_change",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "tallyline-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {times}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
