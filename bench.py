"""Time the headline queries and print one JSON line.

`BENCH_SF_DIR` is the data folder, `BENCH_CPUS` the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from certloom.plans import catalog
from certloom.session import SETTINGS, ensure_utc

HEADLINES = [
    "a1_parse_messages",
    "a3_insert_new",
    "a5_csv_rows",
    "a8_rewrite_daily",
    "a10_compact",
    "a13_lookup_many",
    "b8_ingest_filter",
    "b13_match_spec",
    "b19_registrable_domain",
    "c6_match_searches",
    "c8_trigrams",
    "d1_table_stats",
    "d2_hourly_basics",
    "d3_hourly_top_issuers",
    "d4_daily_top_domains",
    "d9_peak_hourly",
    "d10_hourly_stats",
    "d10_daily_stats",
    "d11_backfill_missing",
    "d13_range_summary",
    "d21_approx_stats",
    "e2_rolling_rate",
    "f2_page",
    "f3_page_after",
    "h1_ingest_stream",
    "h9_tumbling_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("certloom-bench")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = ensure_utc(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINES
    # Start-up of the session and of the first scan is not a query's time.
    catalog.QUERIES["d1_table_stats"](spark, sf_dir).collect()
    timings = {}
    for name in chosen:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
