"""Analytics over events: DataFrame in, DataFrame out, one aggregation each. Ties of every top-k are broken by name."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions import as_utc, bucket, is_error, is_warning, moment, signature

# Columns of correlated events, as shown and as fetched.
FETCHED = ("event_id", "source_alias", "source_path", "line_number", "timestamp", "severity", "message", "service", "trace_id", "span_id", "parent_span_id", "request_id", "session_id", "duration_ms", "status_code")
CORRELATED = ("event_id", "timestamp", "severity", "service", "message", "trace_id", "span_id", "parent_span_id", "request_id", "session_id", "duration_ms", "line_number")


def between(events: DataFrame, start: datetime | None, end: datetime | None, column: str = "timestamp") -> Column:
    """start <= timestamp < end, either side open if None; bounds without an offset are UTC."""
    own, kind, out = F.col(column), events.schema[column].dataType, F.lit(True)
    if start is not None:
        out = out & (own >= moment(start, kind))
    return out if end is None else out & (own < moment(end, kind))


def timeline(events: DataFrame, resolution: str = "minute", start: datetime | None = None, end: datetime | None = None, source_id: int | None = None, limit: int = 5000) -> DataFrame:
    """bucket, count, errors, warnings by time; buckets without events are absent."""
    rows = events.filter(F.col("timestamp").isNotNull() & between(events, start, end))
    if source_id is not None:
        rows = rows.filter(F.col("source_id") == source_id)
    counts = rows.groupBy(bucket(F.col("timestamp"), resolution).alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(is_error()).alias("errors"), F.count_if(is_warning()).alias("warnings")
    )
    return counts.orderBy("bucket").limit(limit)


def severity_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("severity").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "severity")


def severity_counts(events: DataFrame) -> dict[str, int]:
    return {r["severity"]: r["count"] for r in severity_distribution(events).collect()}  # a row a severity


def severity_over_time(events: DataFrame, resolution: str = "minute", severities: tuple[str, ...] = ("ERROR", "WARN", "INFO")) -> DataFrame:
    """bucket, severity, count for the listed severities, in long form."""
    rows = events.filter(F.col("severity").isin(*severities) & F.col("timestamp").isNotNull())
    return rows.groupBy(bucket(F.col("timestamp"), resolution).alias("bucket"), "severity").agg(F.count(F.lit(1)).alias("count")).orderBy("bucket", "severity")


def top_services(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.filter("service is not null").groupBy("service").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "service").limit(limit)


def error_signatures(events: DataFrame) -> DataFrame:
    """signature, total, first_seen, last_seen of errors. Equal messages are summed before the patterns run."""
    messages = events.filter(is_error()).groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("z"))
    return messages.groupBy(signature(F.col("message")).alias("signature")).agg(F.sum("n").alias("total"), F.min("a").alias("first_seen"), F.max("z").alias("last_seen"))


def top_error_signatures(events: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent error signatures, over all messages (not only the most frequent ones)."""
    return error_signatures(events).orderBy(F.desc("total"), "signature").limit(limit)


def group_messages(events: DataFrame, column: str = "message") -> DataFrame:
    """signature and its distinct messages, one row a message, so that a frequent signature is no single value."""
    return events.select(signature(F.col(column)).alias("signature"), F.col(column).alias("message")).distinct()


def _of_any(**ids: str | None) -> Column:
    """Whether any of the given ids is the row's; none given: no row."""
    wanted = [F.col(name) == F.lit(value) for name, value in ids.items() if value]
    return reduce(lambda a, b: a | b, wanted, F.lit(False))


def _correlation(events: DataFrame, columns: tuple[str, ...], **ids: str | None) -> DataFrame:
    return events.filter(_of_any(**ids)).select(*columns).orderBy(F.col("timestamp").asc_nulls_last(), "line_number")


def collect_correlation(events: DataFrame, trace_id: str | None = None, request_id: str | None = None, session_id: str | None = None) -> DataFrame:
    """Events of any of the given ids, in time order; none given: no rows."""
    return _correlation(events, CORRELATED, trace_id=trace_id, request_id=request_id, session_id=session_id)


def fetch_by_correlation(events: DataFrame, trace_id: str | None = None, request_id: str | None = None, session_id: str | None = None) -> DataFrame:
    """The same events with their source and status (FETCHED)."""
    return _correlation(events, FETCHED, trace_id=trace_id, request_id=request_id, session_id=session_id)


def build_hierarchy(correlated: DataFrame) -> DataFrame:
    """Events grouped by service (null is "unknown"), services by their first event; service_start is that time.

    Only the services' first times are aggregated and joined, so a frequent service is no hot window.
    """
    own = F.coalesce("service", F.lit("unknown"))
    starts = correlated.groupBy(own.alias("service_group")).agg(F.min("timestamp").alias("service_start"))
    rows = correlated.withColumn("service_group", own).join(starts, "service_group")
    return rows.orderBy(F.col("service_start").asc_nulls_last(), "service_group", F.col("timestamp").asc_nulls_last(), "line_number")


def recent_events(events: DataFrame, limit: int = 12) -> DataFrame:
    return events.orderBy(F.col("timestamp").desc_nulls_last(), F.col("line_number").desc()).limit(limit)


def events_of_signature(events: DataFrame, wanted: str, limit: int = 500) -> DataFrame:
    """Error events whose normalised message is the signature."""
    return events.filter(is_error() & (signature(F.col("message")) == F.lit(wanted))).orderBy("timestamp", "event_id").limit(limit)


def events_like_signature(events: DataFrame, wanted: str, limit: int = 500) -> DataFrame:
    """Error events whose raw message contains the signature's first 60 characters, wildcards included."""
    pattern = wanted[:60].replace("\\", "\\\\")
    return events.filter(is_error() & F.col("message").like(f"%{pattern}%")).orderBy("timestamp", "event_id").limit(limit)


def time_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"))


def distinct_services(events: DataFrame) -> DataFrame:
    return events.filter("service is not null").select("service").distinct().orderBy("service")


def fetch_event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id).limit(1)


def overview(events: DataFrame) -> DataFrame:
    """One row: events, errors, warnings, first and last time, microseconds between, sources, services."""
    kind = events.schema["timestamp"].dataType
    first, last = (F.unix_micros(as_utc(f("timestamp"), kind)) for f in (F.min, F.max))
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(is_error()).alias("errors"), F.count_if(is_warning()).alias("warnings"), F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"), (last - first).alias("range_micros"),
        F.count_distinct("source_path").alias("sources"), F.count_distinct("service").alias("services"),
    )


def source_summary(events: DataFrame) -> DataFrame:
    """A row a source: alias, path, events, errors, first and last time."""
    return events.groupBy("source_path").agg(F.max("source_alias").alias("source_alias"), F.count(F.lit(1)).alias("events"), F.count_if(is_error()).alias("errors"), F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"))
