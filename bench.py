"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from kithgraph.plans import catalog

#: Cheap ones first; none starts after BENCH_SECONDS, and what was left out is printed.
HEADLINES = ("velocity_pool", "edge_dedup", "parse_frames", "apply_events", "tier2_candidates", "pair_bayesian", "taste_twins_topk", "feed_all_viewers")


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.velocity_pool(spark, sf_dir).count()  # starts the JVM's compilers; not measured
    took, start, limit = {}, time.time(), float(os.environ.get("BENCH_SECONDS", "300"))
    for name in HEADLINES:
        if time.time() - start > limit:
            break
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    viewers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    per = {"feed_viewers_per_s": (viewers, "feed_all_viewers"), "twins_viewers_per_s": (viewers, "taste_twins_topk"), "parse_events_per_s": (events, "parse_frames"), "apply_events_per_s": (events, "apply_events")}
    rates = {k: n / took[q] for k, (n, q) in per.items() if q in took}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "left_out": [q for q in HEADLINES if q not in took], "rates": {k: round(v, 1) for k, v in rates.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
