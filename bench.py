"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose input and cores."""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = ("map_origins", "search_labels", "od_within_time", "limit_nearest", "od_measures_by_areas", "subnet_cells", "crossing_delays", "next_arrivals")


def main() -> None:
    from pyspark.sql import SparkSession

    from isomesh.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    taken = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            catalog.forget()  # each query pays for all that it needs
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        taken[name] = round(median(times), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
