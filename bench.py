"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
cores, ``BENCH_RUNS`` the warm runs whose median counts, ``BENCH_QUERIES`` a
comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from epifold.plans import all_queries

HEADLINE = (
    "point_corrections linelist_deduplicated linelist_first_records monthly_cases monthly_deaths "
    "daily_cumulative_deaths daily_deaths_by_status population_by_province population_national "
    "dose_counts_national cumulative_doses_national death_exposure cumulative_incidence "
    "incidence_long latest_incidence coverage_long coverage_report earliest_doses "
    "provincial_coverage provincial_coverage_display coverage_snapshot region_label_points "
    "yearly_deaths_report monthly_deaths_report conditions_from_flags conditions_from_rows "
    "condition_frequency cause_counts top_causes before_after before_after_report cause_groups "
    "cause_ranking rank_series cause_year_matrix linelist_ingest interval_annotation"
).split()


def session(cpus: str) -> SparkSession:
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("epifold-bench")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="epifold-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(build, spark, sf_dir) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = session(cpus)
    known = all_queries()
    result = {}
    for name in names:
        build = known[name].build
        timed(build, spark, sf_dir)
        result[name] = round(statistics.median(timed(build, spark, sf_dir) for _ in range(runs)), 4)
        print(f"{name} {result[name]}", file=sys.stderr)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(result.values()), 4),
                "unit": "sec",
                "queries": result,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": cpus,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
