"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
threads.  Every query runs once to warm up and then BENCH_RUNS times (default 2); the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans import suite  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "2"))
MORE = ("pruned_scan", "knn_exact", "knn_batch", "text_all")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in suite.QUERIES if n.startswith("tpch_")] + [n for n in MORE if n in suite.QUERIES]
    seconds = {}
    for name in names:
        took = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name.removeprefix("tpch_")] = round(median(took[1:]), 4)
    total = sum(v for k, v in seconds.items() if k[0] == "q" and k[1:].isdigit())
    print(json.dumps({"metric": "tpch_22_total", "value": round(total, 4), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
