"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the folder of Parquet tables, ``BENCH_CPUS`` the number of cores. Each
query runs twice and counts with its faster run; every result row is produced.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from cohortspark import get_session

HEADLINE = [
    "proportion_by_interval",
    "dataset_general",
    "dataset_diabetes",
    "dataset_hypertension",
    "visit_payments",
    "derive_one_var",
    "derive_two_var",
    "top_items",
    "box_stats",
    "box_stats_approximate",
    "histogram_default",
    "crosstab_two",
    "latest_with_ties",
    "chart_bar",
    "run_dashboard",
]


def seconds(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: min(seconds(spark, name, folder) for _ in range(2)) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in times.items()},
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
