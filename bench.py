"""Time the headline queries: BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from foliospark.plans import catalog
from foliospark.plans.bindings import Tables

HEADLINE = [
    "board_summary", "slot_packing", "row_bands", "cache_lookup", "prune_containers", "page_risk", "place_blocks",
    "reading_order", "apply_edits",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foliospark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    spent: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs):
            begun = time.perf_counter()
            catalog.QUERIES[name].build(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begun)
        spent[name] = round(min(times) if runs < 3 else statistics.median(times), 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
