"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from rowgate.plans import queries as core

HEADLINE = (
    core.order_pipeline,
    core.reject_ladder_counts,
    core.batch_outcomes,
    core.lookup_match,
    core.dedupe_first,
    core.upsert_items,
    core.scd2_customer,
    core.file_ledger,
    core.side_by_side,
    core.agreement,
    core.alerts,
    core.aggregate_component,
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took = {}
    for query in HEADLINE:
        best = None
        for _ in range(2):  # the first compiles
            began = time.time()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[query.__name__] = round(best, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "lines": lines, "lines_per_second": {k: round(lines / v) for k, v in took.items()}}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
