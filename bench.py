"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from keyweave import registry

HEADLINE = [
    "copy_intersection", "copy_insert_ignore", "checksum_by_chunk", "checksum_whole_table", "diff_chunks", "diff_rows", "repair_result", "chunk_plan_arithmetic",
    "chunk_plan_quantile_composite", "chunk_plan_four_part", "changes_last_op", "changes_queue_runs", "changes_apply_upsert_delete", "changes_stream_apply", "migration_end_to_end", "migration_four_part_key",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", "file:///tmp/keyweave-bench")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    count = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    rates = {f"{k}_rows_per_s": round(count(t) / took[q]) for k, t, q in (
        ("copy", "orders", "copy_intersection"), ("checksum", "orders", "checksum_by_chunk"), ("diff", "orders", "diff_rows"), ("migration", "lineitem", "migration_four_part_key"))}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, **rates}))


if __name__ == "__main__":
    main()
