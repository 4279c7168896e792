"""Queries over the driver's tables, and the same in DuckDB SQL. Those that write files are in driver_ingest.py."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog import driver_ingest
from sparklog import functions as fn
from sparklog.driver_events import EV, NOW, ORDER, ROWS, Q, events, json_lines, sig
from sparklog.operators import analytics, rules
from sparklog.operators.query import frame
from sparklog.sources import formats


def _rows(where: str, order: str = ORDER, limit: int = 1000) -> str:
    return f"{EV} SELECT {ROWS} FROM ev WHERE {where} {order} LIMIT {limit}"


#: Piped queries and the same in SQL.
PIPED: dict[str, tuple[str, str]] = {
    "eq": ("level = ERROR", _rows("severity = 'ERROR'")),
    "neq": ("severity != ERROR | limit 300", _rows("severity <> 'ERROR'", limit=300)),
    "range_cmp": ("duration_ms >= 50 AND duration < 90.5 AND line_number > 10", _rows("duration_ms >= 50 AND duration_ms < 90.5 AND line_number > 10")),
    "string_number": ('status = "500" and duration_ms > "20"', _rows("status_code = 500 AND duration_ms > 20")),
    "is_null": ("trace_id = NULL", _rows("trace_id IS NULL")),
    "is_not_null": ("session_id != NULL", _rows("session_id IS NOT NULL")),
    "contains": ('message CONTAINS "for user 14"', _rows("contains(message, 'for user 14')")),
    "starts_with_wildcard": ('message STARTS_WITH "p%user 1_"', _rows("message LIKE 'p%user 1_%'")),
    "ends_with": ('message ENDS_WITH "7_"', _rows("message LIKE '%7_'")),
    "in_list": ('service IN ("svc-1", "svc-3") AND status IN (500)', _rows("service IN ('svc-1', 'svc-3') AND status_code IN (500)")),
    "in_list_with_null": ("NOT trace_id IN (t1, NULL)", _rows("NOT trace_id IN ('t1', NULL)")),
    "not_3vl": ("NOT trace_id = t5 AND NOT duration_ms > 40", _rows("NOT trace_id = 't5' AND NOT duration_ms > 40")),
    "and_or_precedence": ("level = ERROR OR level = WARN AND status = 200 OR NOT service != svc-2", _rows("severity = 'ERROR' OR (severity = 'WARN' AND status_code = 200) OR NOT service <> 'svc-2'")),
    "bool_literal": ("TRUE AND NOT FALSE AND level = DEBUG", _rows("severity = 'DEBUG'")),
    "alias_fields": ("service.name = svc-0 AND code = 500 AND latency_ms > 1 AND requestId != NULL", _rows("service = 'svc-0' AND status_code = 500 AND duration_ms > 1 AND request_id IS NOT NULL")),
    "source_field": ('source = events AND raw CONTAINS "click"', _rows("source_alias = 'events' AND contains(raw_text, 'click')")),
    "timestamp_range": ('ts >= "2024-01-05T00:00:00" AND ts < "2024-01-06"', _rows("timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-06'")),
    "default_order_limit": ("| limit 25", _rows("TRUE", limit=25)),
    "empty_query": ("", _rows("TRUE")),
    "comments": ("level = ERROR # only these\n -- and no more\n | limit 40", _rows("severity = 'ERROR'", limit=40)),
    "sort_multi_nulls_last": ("| sort session_id desc, duration_ms, line_number desc | limit 77", _rows("TRUE", "ORDER BY session_id DESC NULLS LAST, duration_ms ASC NULLS LAST, line_number DESC NULLS LAST", 77)),
    "topk_desc": ("status = 500 | sort duration desc, line_number | limit 10", _rows("status_code = 500", "ORDER BY duration_ms DESC NULLS LAST, line_number ASC NULLS LAST", 10)),
    "limit_zero_row": ("level = ERROR | limit 0", _rows("severity = 'ERROR'", limit=1)),
    "count_global": ("| stats count()", f"{EV} SELECT count(*) AS count FROM ev"),
    "count_field": ("| stats count(trace_id), count as n by service", f"{EV} SELECT service, count(trace_id) AS count_trace_id, count(*) AS n FROM ev GROUP BY service"),
    "sum_min_max": ("| stats sum(status), min(timestamp), max(line_number), min(message) by severity", f"{EV} SELECT severity, CAST(sum(status_code) AS BIGINT) AS sum_status_code, min(timestamp) AS min_timestamp, max(line_number) AS max_line_number, min(message) AS min_message FROM ev GROUP BY severity"),
    "p50_p95_by": ("| stats p50(duration), p95(duration) as p by service", f"{EV} SELECT service, round(quantile_cont(duration_ms, 0.5), 6) AS p50_duration_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p FROM ev GROUP BY service"),
    "multi_group_by": ("duration_ms > 10 | stats count, max(duration_ms) by severity, service, session_id", f"{EV} SELECT severity, service, session_id, count(*) AS count, max(duration_ms) AS max_duration_ms FROM ev WHERE duration_ms > 10 GROUP BY ALL"),
    "stats_sort_alias_limit": ("| stats count as n, p95(latency_ms) by trace_id | sort n desc, trace_id | limit 12", f"{EV} SELECT trace_id, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95_duration_ms FROM ev GROUP BY trace_id ORDER BY n DESC NULLS LAST, trace_id ASC NULLS LAST LIMIT 12"),
    "stats_on_empty": ("level = NOSUCH | stats count(), max(duration_ms)", f"{EV} SELECT count(*) AS count, max(duration_ms) AS max_duration_ms FROM ev WHERE severity = 'NOSUCH'"),
    "stats_limit_zero": ("| stats count by service | limit 0", f"{EV} SELECT service, count(*) AS count FROM ev GROUP BY service LIMIT 0"),
    "stage_order": ("| limit 3 | stats count() by severity | limit 100 | sort count", f"{EV} SELECT severity, count(*) AS count FROM ev GROUP BY severity"),
}


def _time(unit: str) -> str:
    bucket = "date_trunc('minute', timestamp) - INTERVAL (minute(timestamp) % 5) MINUTE" if unit == "five_minutes" else f"date_trunc('{unit}', timestamp)"
    return f"CAST({bucket} AS TIMESTAMP)"


def _timeline_sql(unit: str, where: str = "TRUE") -> str:
    return f"{EV} SELECT {_time(unit)} AS bucket, count(*) AS count, count(*) FILTER (severity IN ('ERROR', 'FATAL', 'CRITICAL')) AS errors, count(*) FILTER (severity IN ('WARN', 'WARNING')) AS warnings FROM ev WHERE {where} GROUP BY 1 ORDER BY 1 LIMIT 5000"


def _context(rule: str, spark: SparkSession, sf_dir: str, **parameters) -> rules.Context:
    return rules.Context(events(spark, sf_dir), rules.RuleConfig(rule, rule, parameters=parameters), NOW, "ws-driver")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def avg_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(frame(events(spark, sf_dir), "| stats avg(duration_ms), count() by service"), "avg_duration_ms")


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: errors by service with mean and 95th percentile of durations."""
    return _rounded(frame(events(spark, sf_dir), "level = ERROR | stats count(), avg(duration_ms), p95(duration_ms) by service | sort count desc"), "avg_duration_ms", "p95_duration_ms")


def signature_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", fn.signature(F.col("text")).alias("signature"))


def group_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.group_messages(events(spark, sf_dir).filter("severity = 'ERROR'"))
    return found.groupBy("signature").agg(F.count(F.lit(1)).alias("messages"))


def hierarchy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.build_hierarchy(analytics.collect_correlation(events(spark, sf_dir), trace_id="t7", session_id="s9"))
    return found.select("service_group", "service_start", "event_id", "timestamp")


def normalize_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.element_at(F.array(*map(F.lit, ["err", " Crit ", "panic", "dbg", "information", "warning", "", "custom", "EMERG", "info"])), (F.col("event_id") % 10 + 1).cast("int"))
    return raw.select("event_id", fn.severity_of(level).alias("severity"))


def event_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    return own.select("line_number", fn.event_id(F.col("source_path"), F.col("message"), F.when(F.col("line_number") % 4 != 0, F.col("byte_offset")), F.col("line_number")).alias("id"))


def epoch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds, milliseconds and microseconds of the same times are one time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    unit = F.element_at(F.array(F.lit(1_000_000), F.lit(1000), F.lit(1)), (F.col("event_id") % 3 + 1).cast("int"))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", (F.unix_micros(fn.epoch_timestamp(F.floor(micros / unit))) - F.floor(micros / unit) * unit).alias("off"))


def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formats.parse_json(json_lines(spark, sf_dir), formats.Source("a"))
    return found.select("line_number", "severity", "message", "trace_id", "duration_ms", "status_code", F.unix_micros("timestamp").alias("micros"), "attributes_json", "unstructured")


def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    text = F.concat_ws(",", F.col("severity"), F.concat(F.lit('"'), F.col("message"), F.lit(', ""done"""')), F.col("service"), F.col("status_code").cast("string"))
    found = formats.parse_csv(own.select("source_path", "byte_offset", "line_number", text.alias("text")), ["level", "message", "service", "status"], formats.Source("a"))
    return found.select("line_number", "severity", "message", "service", "status_code")


def text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.when(F.col("line_number") % 2 == 0, F.concat(stamp, F.lit(" "), F.col("severity"), F.lit(" ["), F.col("service"), F.lit("] "), F.col("message"))).otherwise(F.concat(F.lit("["), stamp, F.lit("] ["), F.col("severity"), F.lit("] "), F.col("message")))
    found = formats.parse_text(own.select("source_path", "byte_offset", "line_number", line.alias("text")), formats.Source("a"))
    return found.select("line_number", "severity", "message", "service", F.unix_micros("timestamp").alias("micros"), "unstructured")


def regex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("source_path", "byte_offset", "line_number", F.col("message").alias("text"))
    source = formats.Source("a", regex=r"(?P<kind>\w+) for user (?P<user>[0-4]\d*) request (?P<n>\d+)", field_map={"level": "kind", "service": "user", "duration_ms": "n"})
    return formats.parse_regex(own, source).select("line_number", "severity", "service", "duration_ms", "unstructured")


_RATE = (
    EV + ", c AS (SELECT count(*) FILTER (timestamp >= TIMESTAMP '2024-01-19' AND timestamp < TIMESTAMP '2024-01-20') AS total_now, count(*) FILTER (timestamp >= TIMESTAMP '2024-01-19' AND timestamp < TIMESTAMP '2024-01-20' AND severity IN ('ERROR', 'FATAL', 'CRITICAL')) AS errors_now,"
    " count(*) FILTER (timestamp >= TIMESTAMP '2024-01-14' AND timestamp < TIMESTAMP '2024-01-19') AS total_base, count(*) FILTER (timestamp >= TIMESTAMP '2024-01-14' AND timestamp < TIMESTAMP '2024-01-19' AND severity IN ('ERROR', 'FATAL', 'CRITICAL')) AS errors_base FROM ev WHERE timestamp >= TIMESTAMP '2024-01-14' AND timestamp < TIMESTAMP '2024-01-20')"
    " SELECT *, coalesce(errors_now / nullif(total_now, 0), 0) AS rate_now, coalesce(errors_base / nullif(total_base, 0), 0) AS rate_base FROM c WHERE errors_now >= {least} AND coalesce(errors_base / nullif(total_base, 0), 0) > 0 AND coalesce(errors_now / nullif(total_now, 0), 0) >= {times} * coalesce(errors_base / nullif(total_base, 0), 0)"
)
_BURST = EV + ", c AS (SELECT count(*) FILTER (timestamp >= TIMESTAMP '2024-01-19' AND timestamp < TIMESTAMP '2024-01-20') AS recent, count(*) FILTER (timestamp >= TIMESTAMP '2024-01-14' AND timestamp < TIMESTAMP '2024-01-19') AS base FROM ev) SELECT *, base * 1440.0::DOUBLE / 7200 AS expected FROM c WHERE base > 0 AND recent >= base * 1440.0::DOUBLE / 7200 * {times}"

#: Other queries: function, SQL (None: rows only).
OTHERS: dict[str, tuple[Q, str | None]] = {
    "error_summary": (error_summary, f"{EV} SELECT service, count(*) AS count, round(avg(duration_ms), 6) AS avg_duration_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_duration_ms FROM ev WHERE severity = 'ERROR' GROUP BY service"),
    "avg_by": (avg_by, f"{EV} SELECT service, round(avg(duration_ms), 6) AS avg_duration_ms, count(*) AS count FROM ev GROUP BY service"),
    **{f"timeline_{u.replace('five_minutes', '5min')}": (lambda s, d, u=u: analytics.timeline(events(s, d), u), _timeline_sql(u)) for u in fn.RESOLUTIONS},
    "timeline_ranged": (lambda s, d: analytics.timeline(events(s, d), "hour", datetime(2024, 1, 3), datetime(2024, 1, 5, 12), 1), _timeline_sql("hour", "timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-05 12:00:00' AND source_id = 1")),
    "severity_over_time": (lambda s, d: analytics.severity_over_time(events(s, d), "day"), f"{EV} SELECT {_time('day')} AS bucket, severity, count(*) AS count FROM ev WHERE severity IN ('ERROR', 'WARN', 'INFO') GROUP BY 1, 2"),
    "severity_distribution": (lambda s, d: analytics.severity_distribution(events(s, d)), f"{EV} SELECT severity, count(*) AS count FROM ev GROUP BY severity"),
    "top_services": (lambda s, d: analytics.top_services(events(s, d), 3), f"{EV} SELECT service, count(*) AS count FROM ev GROUP BY service ORDER BY count DESC, service LIMIT 3"),
    "time_range": (lambda s, d: analytics.time_range(events(s, d)), f"{EV} SELECT min(timestamp) AS first_event, max(timestamp) AS last_event FROM ev"),
    "distinct_services": (lambda s, d: analytics.distinct_services(events(s, d)), f"{EV} SELECT DISTINCT service FROM ev WHERE service IS NOT NULL"),
    "overview": (lambda s, d: analytics.overview(events(s, d)), f"{EV} SELECT count(*) AS events, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings, min(timestamp) AS first_event, max(timestamp) AS last_event, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS range_micros, count(DISTINCT source_path) AS sources, count(DISTINCT service) AS services FROM ev"),
    "fetch_event": (lambda s, d: analytics.fetch_event(events(s, d), "e77").drop("logger", "process", "thread", "span_id", "parent_span_id"), f"{EV} SELECT * EXCLUDE (logger, process, thread, span_id, parent_span_id) FROM ev WHERE event_id = 'e77'"),
    "top_error_signatures": (lambda s, d: analytics.top_error_signatures(events(s, d)), f"{EV} SELECT {sig('message')} AS signature, count(*) AS total, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ev WHERE severity IN ('ERROR', 'FATAL', 'CRITICAL') GROUP BY 1 ORDER BY total DESC, signature LIMIT 20"),
    "signature_of_documents": (signature_of_documents, f"SELECT doc_id, {sig('text')} AS signature FROM documents"),
    "group_messages": (group_messages, f"{EV} SELECT {sig('message')} AS signature, count(DISTINCT message) AS messages FROM ev WHERE severity = 'ERROR' GROUP BY 1"),
    "events_of_signature": (lambda s, d: analytics.events_of_signature(events(s, d), "error for user <num> request <num>").select("event_id"), f"{EV} SELECT event_id FROM ev WHERE severity = 'ERROR' AND {sig('message')} = 'error for user <num> request <num>' ORDER BY timestamp, event_id LIMIT 500"),
    "events_like_signature": (lambda s, d: analytics.events_like_signature(events(s, d), "for user 4").select("event_id"), f"{EV} SELECT event_id FROM ev WHERE severity = 'ERROR' AND message LIKE '%for user 4%' ORDER BY timestamp, event_id LIMIT 500"),
    "correlation_or": (lambda s, d: analytics.collect_correlation(events(s, d), "t3", "r40", "s11").drop("span_id", "parent_span_id"), f"{EV} SELECT event_id, timestamp, severity, service, message, trace_id, request_id, session_id, duration_ms, line_number FROM ev WHERE trace_id = 't3' OR request_id = 'r40' OR session_id = 's11'"),
    "hierarchy_order": (hierarchy_order, f"{EV} SELECT service AS service_group, min(timestamp) OVER (PARTITION BY service) AS service_start, event_id, timestamp FROM ev WHERE trace_id = 't7' OR session_id = 's9'"),
    "recent_events": (lambda s, d: analytics.recent_events(events(s, d)).select("event_id", "timestamp"), f"{EV} SELECT event_id, timestamp FROM ev ORDER BY timestamp DESC NULLS LAST, line_number DESC LIMIT 12"),
    "rule_error_rate_spike": (lambda s, d: _rounded(rules.error_rate_counts(_context("error_rate_spike", s, d, window_min=1440, baseline_min=7200, threshold_multiple=0.5, min_errors=1)), "rate_now", "rate_base"), "SELECT total_now, errors_now, total_base, errors_base, round(rate_now, 6) AS rate_now, round(rate_base, 6) AS rate_base FROM (" + _RATE.format(least=1, times=0.5) + ")"),
    "rule_error_rate_silent": (lambda s, d: rules.error_rate_counts(_context("error_rate_spike", s, d, window_min=1440, baseline_min=7200, threshold_multiple=3.0, min_errors=1)), _RATE.format(least=1, times=3.0)),
    "rule_new_error_signature": (lambda s, d: rules.new_signatures(_context("new_error_signature", s, d, window_min=60 * 24 * 19)), f"{EV} SELECT {sig('message')} AS signature, min(timestamp) AS first_seen FROM ev WHERE severity IN ('ERROR', 'FATAL', 'CRITICAL') GROUP BY 1 HAVING min(timestamp) >= TIMESTAMP '2024-01-01' ORDER BY 2, 1 LIMIT 50"),
    "rule_latency_threshold": (lambda s, d: _rounded(rules.slow_services(_context("latency_threshold", s, d, window_min=7200, threshold_ms=1.0)), "p95"), f"{EV} SELECT service, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM ev WHERE timestamp >= TIMESTAMP '2024-01-15' AND duration_ms IS NOT NULL GROUP BY service HAVING count(*) >= 5 AND quantile_cont(duration_ms, 0.95) >= 1.0"),
    "rule_event_burst": (lambda s, d: rules.burst_counts(_context("event_burst", s, d, window_min=1440, baseline_min=7200, factor=0.2)), _BURST.format(times=0.2)),
    "rule_event_burst_silent": (lambda s, d: rules.burst_counts(_context("event_burst", s, d, window_min=1440, baseline_min=7200, factor=9.0)), _BURST.format(times=9.0)),
    "rule_missing_heartbeat": (lambda s, d: rules.silent_services(rules.Context(events(s, d).filter("service <> 'svc-2' or timestamp < timestamp_ntz '2024-01-10'"), rules.RuleConfig("m", "missing_heartbeat", parameters={"silence_min": 2880}), datetime(2024, 1, 31))), f"{EV} SELECT service, max(timestamp) AS last_seen FROM ev WHERE service <> 'svc-2' OR timestamp < TIMESTAMP '2024-01-10' GROUP BY service HAVING max(timestamp) < TIMESTAMP '2024-01-29'"),
    "rule_alerts": (lambda s, d: rules.RULES["missing_heartbeat"](rules.Context(events(s, d), rules.RuleConfig("m", "missing_heartbeat", parameters={"silence_min": 60}), datetime(2024, 3, 1), "ws-driver")).select("rule_id", "severity", F.col("scope")["service"].alias("service"), F.length("id").alias("id_length")), f"{EV} SELECT DISTINCT 'missing_heartbeat' AS rule_id, 'NOTICE' AS severity, service, 21 AS id_length FROM ev"),
    "normalize_severity": (normalize_severity, "SELECT event_id, ['ERROR', 'CRITICAL', 'FATAL', 'DEBUG', 'INFO', 'WARNING', 'UNKNOWN', 'CUSTOM', 'FATAL', 'INFO'][event_id % 10 + 1] AS severity FROM events"),
    "event_id_hash": (event_id_hash, EV + "SELECT line_number, 'tfevt-' || substr(sha1(source_path || '|' || CASE WHEN line_number % 4 <> 0 THEN '@' || byte_offset WHEN line_number > 0 THEN 'L' || line_number ELSE '@?' END || '|' || substr(sha1(message), 1, 16)), 1, 24) AS id FROM ev"),
    "epoch_units": (epoch_units, "SELECT event_id, CAST(0 AS BIGINT) AS off FROM events"),
    "jsonl_parse": (jsonl_parse, EV + "SELECT line_number, severity, message, trace_id, duration_ms, status_code, epoch_us(timestamp) AS micros, '{\"extra\":\"x\"}' AS attributes_json, false AS unstructured FROM ev"),
    "csv_parse": (csv_parse, EV + "SELECT line_number, severity, message || ', \"done\"' AS message, service, status_code FROM ev"),
    "text_parse": (text_parse, EV + "SELECT line_number, severity, message, CASE WHEN line_number % 2 = 0 THEN service END AS service, epoch_us(timestamp) AS micros, false AS unstructured FROM ev"),
    "regex_parse": (regex_parse, EV + r"SELECT line_number, CASE WHEN regexp_matches(message, 'user [0-4]\d* request') THEN upper(split_part(message, ' ', 1)) ELSE 'UNKNOWN' END AS severity, CASE WHEN regexp_matches(message, 'user [0-4]\d* request') THEN split_part(message, ' ', 4) END AS service, CASE WHEN regexp_matches(message, 'user [0-4]\d* request') THEN CAST(line_number AS DOUBLE) END AS duration_ms, NOT regexp_matches(message, 'user [0-4]\d* request') AS unstructured FROM ev"),
}


#: Interpolated percentiles differ in the last bits.
ROUNDED = {"p50_p95_by": ("p50_duration_ms", "p"), "stats_sort_alias_limit": ("p95_duration_ms",)}


def queries() -> dict[str, Q]:
    piped = {name: (lambda s, d, name=name, text=text: _rounded(frame(events(s, d), text), *ROUNDED.get(name, ()))) for name, (text, _) in PIPED.items()}
    return piped | {name: f for name, (f, _) in (OTHERS | driver_ingest.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (PIPED | OTHERS | driver_ingest.QUERIES).items() if sql}
