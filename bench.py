"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query's seconds are the best of two runs after one warm-up, to a no-op sink. `ingest_events_per_s` is the rate of
parsing JSON lines with exact offsets and appending them to a deduplicating store. `at_1m` has the same at 1,000,000
events, and `job` the seconds of a query over one row, which any query has besides its work; neither is in the total.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparklog import demo, driver_queries
from sparklog.operators.query import frame
from sparklog.operators.store import EventStore
from sparklog.sources.ingest import ingest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ("error_summary", "eq", "topk_desc", "p50_p95_by", "timeline_minute", "timeline_5min", "top_error_signatures", "correlation_or", "rule_new_error_signature", "rule_error_rate_spike", "jsonl_parse", "text_parse", "dedup_append", "signature_of_documents")


def timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


STORED = {"stored_errors": "severity = ERROR", "stored_service": 'service = "payments"', "stored_slow_top": "duration_ms > 100 | sort timestamp desc | limit 100"}


def best(make: Callable[[], DataFrame]) -> float:
    return round(min([timed(make()) for _ in range(3)][1:]), 4)


def stored(spark: SparkSession, n: int) -> tuple[dict[str, float], float]:
    """Seconds of ingesting a demo of n events and of queries over the store, and the store's MB."""
    work = tempfile.mkdtemp(prefix="sparklog-bench-")  # a local session: one machine
    try:
        demo.write_demo(spark, f"{work}/demo", n)
        store = EventStore(spark, f"{work}/store")
        began = time.perf_counter()
        inserted = ingest(spark, store, f"{work}/demo", parser="jsonl").inserted
        took = time.perf_counter() - began
        if inserted != n:
            raise RuntimeError(f"{inserted} of {n} events were stored")
        seconds = {name: best(lambda text=text: frame(store.events(), text)) for name, text in STORED.items()}
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{work}/store") for f in files)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return seconds | {"ingest": round(took, 3)}, round(size / 1e6, 2)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = driver_queries.queries()
    seconds = {name: best(lambda name=name: queries[name](spark, SF_DIR)) for name in NAMES}
    small, size = stored(spark, 100_000)
    seconds |= {k: v for k, v in small.items() if k != "ingest"} | {"ingest_100k": small["ingest"]}
    large, large_size = stored(spark, 1_000_000)
    more = {"at_1m": large | {"store_mb": large_size}, "job": best(lambda: spark.range(1).repartition(1))}
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR, "ingest_events_per_s": round(100_000 / small["ingest"]), "store_mb_100k": size} | more))


if __name__ == "__main__":
    main()
