"""The event table: its columns, the names that queries may use, and severities."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of this module: names and types of columns, names in queries, labels, severities.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("source_id", T.LongType(), False),
    T.StructField("source_alias", T.StringType(), False),
    T.StructField("source_path", T.StringType(), False),
    T.StructField("line_number", T.LongType(), False),
    T.StructField("byte_offset", T.LongType()),
    T.StructField("raw_format", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("ingested_at", T.TimestampType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("raw_text", T.StringType(), False),
    T.StructField("service", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("process", T.StringType()),
    T.StructField("thread", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_span_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("exception_type", T.StringType()),
    T.StructField("attributes_json", T.StringType()),
])
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

#: Other names of columns in queries; all event columns but those in HIDDEN go by their own name.
ALIASES = {
    "level": "severity", "ts": "timestamp", "time": "timestamp", "@timestamp": "timestamp", "service.name": "service", "traceId": "trace_id", "spanId": "span_id",
    "requestId": "request_id", "sessionId": "session_id", "duration": "duration_ms", "latency_ms": "duration_ms", "status": "status_code", "code": "status_code",
    "raw": "raw_text", "source": "source_alias",
}
HIDDEN = {"source_id", "source_alias", "raw_text", "attributes_json"}
QUERY_FIELDS = tuple(c for c in EVENT_COLUMNS if c not in HIDDEN) + ("source",)

#: Columns of a row result, in this order.
ROW_COLUMNS = (
    "event_id", "timestamp", "ingested_at", "severity", "service", "logger", "host", "message", "raw_text", "source_path", "source_alias", "line_number",
    "trace_id", "span_id", "parent_span_id", "request_id", "session_id", "duration_ms", "status_code", "exception_type", "raw_format",
)
DISPLAY = {
    "timestamp": "Timestamp", "severity": "Level", "service": "Service", "message": "Message", "source_alias": "Source", "trace_id": "Trace ID", "request_id": "Request ID",
    "duration_ms": "Duration (ms)", "status_code": "Status", "logger": "Logger", "host": "Host", "process": "Process", "thread": "Thread", "exception_type": "Exception",
    "raw_format": "Format", "line_number": "Line", "event_id": "Event ID", "source_path": "Path",
}

SEVERITIES = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL", "UNKNOWN")
SEVERITY_ALIASES = {"ERR": "ERROR", "CRIT": "CRITICAL", "EMERG": "FATAL", "EMERGENCY": "FATAL", "ALERT": "FATAL", "PANIC": "FATAL", "DBG": "DEBUG", "INFORMATION": "INFO"}
ERRORS = ("ERROR", "FATAL", "CRITICAL")
WARNINGS = ("WARN", "WARNING")
