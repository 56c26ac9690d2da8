"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up, then ``$BENCH_RUNS`` times; the figure is the median, with the
building of the plan included. ``build`` has the part of it that making and analysing the plan takes. Every row of the result is computed (a ``noop`` write), and nothing
is cached between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import registry  # noqa: E402

HEADLINE = (
    "scan_slim",
    "tabulate_deaths",
    "tabulate_births",
    "redistribute_deaths",
    "redistribute_births",
    "population_total",
    "moving_average_deaths",
    "ddm_input",
    "mid_population",
    "ggb_fit",
    "seg",
    "ggb_seg",
    "choose_coverage",
    "adjust_deaths",
    "implied_birth_rate",
    "birth_coverage",
    "birth_coverage_smoothed",
    "region_result",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vitalcov-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, build = {}, {}
    for name in HEADLINE:
        times, built = [], []
        for _ in range(runs + 1):
            start = time.perf_counter()
            result = registry.QUERIES[name](spark, sf_dir)
            built.append(time.perf_counter() - start)
            result.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        build[name] = round(statistics.median(built[1:]), 3)
        print(f"{name}: {seconds[name]} s, {build[name]} s of it to build (first {times[0]:.1f} s)", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "build": build,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
