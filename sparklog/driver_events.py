"""The driver's `events` mapped to the event columns, in Spark and in DuckDB SQL, and texts rendered from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.schema import ROW_COLUMNS

NOW = datetime(2024, 1, 20)
Q = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as event rows; every seventh lacks ids and duration."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    gap = F.col("event_id") % 7 == 0
    kind, user, number = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    severity = F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "purchase", "INFO").when(kind == "click", "DEBUG").otherwise("TRACE")
    message = F.concat(kind, F.lit(" for user "), user, F.lit(" request "), number)
    none = F.lit(None).cast("string")
    columns = {
        "event_id": F.concat(F.lit("e"), number), "source_id": F.lit(1).cast("long"), "source_alias": F.lit("events"), "source_path": F.lit("/data/events"), "line_number": F.col("event_id"),
        "byte_offset": F.col("event_id") * 100, "raw_format": F.lit("json"), "timestamp": F.col("ts"), "ingested_at": F.col("ts"), "severity": severity, "message": message, "raw_text": message,
        "service": F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")), "logger": none, "host": F.concat(F.lit("host_"), (F.col("user_id") % 3).cast("string")), "process": none, "thread": none,
        "trace_id": F.when(~gap, F.concat(F.lit("t"), user)), "span_id": none, "parent_span_id": none, "request_id": F.concat(F.lit("r"), number),
        "session_id": F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("s"), user)), "duration_ms": F.when(~gap, F.col("value")), "status_code": F.when(kind == "error", 500).otherwise(200),
        "exception_type": F.when(kind == "error", "EventError"), "attributes_json": F.col("props"),
    }
    return raw.select(*[c.alias(n) for n, c in columns.items()])


EV = """WITH ev AS (SELECT 'e' || event_id AS event_id, CAST(1 AS BIGINT) AS source_id, 'events' AS source_alias, '/data/events' AS source_path, event_id AS line_number, event_id * 100 AS byte_offset,
  'json' AS raw_format, ts AS timestamp, ts AS ingested_at, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS severity,
  event_type || ' for user ' || user_id || ' request ' || event_id AS message, event_type || ' for user ' || user_id || ' request ' || event_id AS raw_text, 'svc-' || (user_id % 5) AS service,
  CAST(NULL AS VARCHAR) AS logger, 'host_' || (user_id % 3) AS host, CAST(NULL AS VARCHAR) AS process, CAST(NULL AS VARCHAR) AS thread, CASE WHEN event_id % 7 <> 0 THEN 't' || user_id END AS trace_id,
  CAST(NULL AS VARCHAR) AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 'r' || event_id AS request_id, CASE WHEN event_id % 3 <> 0 THEN 's' || user_id END AS session_id,
  CASE WHEN event_id % 7 <> 0 THEN value END AS duration_ms, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status_code, CASE event_type WHEN 'error' THEN 'EventError' END AS exception_type,
  props AS attributes_json FROM events) """
ROWS = ", ".join(ROW_COLUMNS)
ORDER = "ORDER BY timestamp ASC NULLS LAST, line_number ASC"
SIG = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''),"
    r" '\x1B\[[0-?]*[ -/]*[@-~]', '', 'g'), '\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?', '<ts>', 'g'),"
    r" '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', '<uuid>', 'g'), '0x[0-9a-fA-F]+', '<addr>', 'g'),"
    r" '(^|[^0-9A-Fa-f\p{{L}}])[0-9A-Fa-f]{{16,}}([^0-9A-Fa-f\p{{L}}]|$)', '\1<hex>\2', 'g'), '(^|[^0-9A-Fa-f\p{{L}}])[0-9A-Fa-f]{{16,}}([^0-9A-Fa-f\p{{L}}]|$)', '\1<hex>\2', 'g'),"
    r""" '\d+\.\d+', '<num>', 'g'), '(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}{{2,}}', '\1<num>', 'g'), 'File "[^"]+", line \d+', 'File <path>', 'g'), '"[^"\n]{{6,}}"', '"<str>"', 'g'),"""
    r" '[\p{{L}}\p{{N}}_\-]{{16,}}', '<id>', 'g'), '\s+', ' ', 'g'))"
)


def sig(column: str) -> str:
    s = SIG.format(column)
    return f"CASE WHEN length({s}) > 240 THEN substr({s}, 1, 240) || '...' ELSE {s} END"


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    text = F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.col("severity").alias("level"), F.col("message").alias("msg"), F.col("trace_id").alias("traceId"), F.col("duration_ms").alias("latency_ms"), F.col("status_code").alias("code"), F.lit("x").alias("extra")))
    return own.select("source_path", "byte_offset", "line_number", text.alias("text"))
