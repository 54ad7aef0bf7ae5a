"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with warm seconds for each query."""

import json
import os
import time

from pyspark.sql import SparkSession

from sparkwell.plans.queries import QUERIES

HEADLINE = ("dense_topk", "bm25_topk", "fusion_rrf", "pii_mask", "sentence_windows", "keyword_table", "ingestion_dedup", "relation_map", "html_text", "memory_budget")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
