"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans import catalogue

NAMES = ["topk_tanimoto_greater", "topk_sharded_merge", "topk_text_tokens", "similarity_graph_greater", "graph_degree", "descriptor_batch", "range_filter_both", "ordered_concat", "derived_job_status", "task_stats", "claim_next", "quorum_winner", "latest_vote", "tumbling_events"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(2):  # the second runs compiled
            at = time.time()
            catalogue.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - at)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder}))


if __name__ == "__main__":
    main()
