"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores, BENCH_QUERIES (comma
separated) other queries than the headline ones.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload import registered

HEADLINE = (
    "diff_child",
    "diff_child_duplicates",
    "diff_entity",
    "metrics_run",
    "metrics_run_by_snapshot",
    "fp_columns",
    "fp_functions",
    "fp_references",
    "report_schema_impact",
    "report_table_summary",
    "report_column_impact",
    "snapshot_run",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("driftmark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session(cpus)
    runs = registered()

    def timed(name: str, folder: str) -> float:
        started = time.monotonic()
        runs[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.monotonic() - started, 3)

    # The first query of a session pays for class loading and code generation.
    timed("diff_child", sf_dir)
    seconds = {name: timed(name, sf_dir) for name in names}
    compared = 2 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "diff_child_duplicates" in seconds:
        result["diff_rows_per_sec"] = round(compared / seconds["diff_child_duplicates"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
