"""Demo logs of five services with three incidents, generated by Spark: any number of events, equal for equal seeds."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES = ("api", "auth", "payments", "orders", "database")
MESSAGES = {"INFO": "Request completed in %d ms", "DEBUG": "Cache lookup took %d ms", "WARN": "Slow response: %d ms", "ERROR": "Connection timeout after %d ms"}


def demo_events(spark: SparkSession, n: int = 10_000, start: datetime = datetime(2026, 9, 1, 12), minutes: int = 120, seed: int = 42, incidents: bool = True) -> DataFrame:
    """timestamp, level, service, logger, host, trace_id, span_id, request_id, duration_ms, status_code, exception_type, message.

    Services take turns. Payments is slow for a quarter of the time from the middle on; one circuit opens at 65 %; the
    last sixth from 85 % on has errors only in orders. Without incidents there is none of this.
    """

    def draw(salt: int, most: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(most))

    rows = spark.range(n).withColumn("service", F.element_at(F.array(*map(F.lit, SERVICES)), (F.col("id") % 5 + 1).cast("int")))
    at = F.col("id") / F.lit(max(1, n))
    real = F.lit(incidents)
    slow = real & (F.col("service") == "payments") & at.between(0.5, 0.75)
    circuit = real & (F.col("id") == int(n * 0.65))
    failing = real & (F.col("service") == "orders") & (at >= 0.85)
    level = F.when(circuit | failing, "ERROR").when(slow, "WARN").when(draw(1, 100) < 2, "ERROR").when(draw(1, 100) < 8, "WARN").when(draw(1, 100) < 20, "DEBUG").otherwise("INFO")
    duration = F.when(slow, 900 + draw(2, 2000)).otherwise(5 + draw(2, 300)).cast("double")
    step = timedelta(minutes=minutes).total_seconds() / max(1, n)
    out = rows.withColumns({"level": level, "duration_ms": duration})
    message = F.lit(None).cast("string")
    for name, text in MESSAGES.items():
        message = F.when(F.col("level") == name, F.format_string(text, F.col("duration_ms").cast("long"))).otherwise(message)
    stamp = F.date_format(F.timestamp_micros((F.lit(start.replace(tzinfo=UTC).timestamp()) * 1e6 + F.col("id") * step * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    hexed = lambda salt, digits: F.substring(F.sha1(F.concat_ws("|", F.lit(seed), F.lit(salt), F.floor(F.col("id") / 5))), 1, digits)
    return out.select(
        "id", stamp.alias("timestamp"), "level", "service", F.concat(F.lit("app."), F.col("service")).alias("logger"), F.concat(F.lit("host-"), draw(3, 4) + 1).alias("host"), hexed(4, 16).alias("trace_id"),
        F.substring(F.sha1(F.concat_ws("|", F.lit(seed), F.col("id"))), 1, 8).alias("span_id"), F.concat(F.lit("req-"), hexed(5, 10)).alias("request_id"), "duration_ms",
        F.when(F.col("level") == "ERROR", 500).otherwise(200).alias("status_code"), F.when(circuit, "CircuitOpenError").when(F.col("level") == "ERROR", "TimeoutError").alias("exception_type"),
        F.when(circuit, "Circuit breaker opened for payments").otherwise(message).alias("message"),
    )


def write_demo(spark: SparkSession, folder: str, n: int = 10_000, **options) -> None:
    """JSON lines of the demo, a folder a service."""
    rows = demo_events(spark, n, **options).repartition("service").sortWithinPartitions("id").drop("id")
    rows.withColumn("file", F.col("service")).write.mode("overwrite").partitionBy("file").json(folder)
