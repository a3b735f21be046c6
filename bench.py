"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the no-op sink, once to warm up and once timed, so all its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave import catalog  # noqa: E402

HEADLINE = (
    "source_minute", "source_health", "overview", "syslog_fields", "peel_by_contract", "extract_by_template", "map_rows", "assign_tier", "template_signature", "token_table", "mask_route", "search_index",
    "search_hits", "latest_revision", "brute_force", "drift_groups", "backtest", "hash_chain", "merkle_roots", "event_detail", "raw_index",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")),
        "events": events, "events_per_sec": {k: round(events / took[k]) for k in ("syslog_fields", "peel_by_contract", "extract_by_template", "map_rows", "assign_tier", "template_signature", "token_table", "raw_index")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
