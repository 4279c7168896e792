"""Queries that write the driver's events as files, read them back through sources, store, tail or exports, and the same in DuckDB SQL."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog import export
from sparklog.driver_events import EV, NOW, Q, events, json_lines, sig
from sparklog.folders import work_folder
from sparklog.operators import analytics, rules
from sparklog.operators.query import QueryError, display, frame, validate
from sparklog.operators.store import EventStore
from sparklog.sources import formats
from sparklog.sources.ingest import IngestResult, ingest
from sparklog.sources.lines import fold_lines, read_lines
from sparklog.streaming.tail import start_tail


def _file(lines: DataFrame, folder: str, *order: str) -> None:
    """lines(text) in order as one file, in a new folder."""
    lines.orderBy(*order).select("text").coalesce(1).write.text(folder)


def _log_file(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with the events as one file of JSON lines in its folder logs."""
    work = work_folder(spark)
    _file(json_lines(spark, sf_dir), f"{work}/logs", "line_number")
    return work


def _stored(store: EventStore) -> DataFrame:
    return store.events().select("severity", "message", "trace_id", "duration_ms", "status_code", F.unix_micros("timestamp").alias("micros"), "line_number")


def _stamped(events_: DataFrame) -> Column:
    return F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_number, text: the events as ISO text lines."""
    own = events(spark, sf_dir)
    return own.select("line_number", F.concat(_stamped(own), F.lit(" "), "severity", F.lit(" ["), "service", F.lit("] "), "message").alias("text"))


def multiline_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: each line a log line, those that begin with a letter from A to M a primary one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.col("doc_id").cast("string").alias("source_path"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    stamped = F.when(F.col("text").rlike("^[A-M]"), F.concat(F.lit("2024-01-01 00:00:00 INFO "), F.col("text"))).otherwise(F.concat(F.lit("  "), F.col("text")))
    lines = lines.select("source_path", F.col("k").cast("long").alias("byte_offset"), (F.col("k") + 1).cast("long").alias("line_number"), stamped.alias("text"))
    return fold_lines(lines).select("source_path", "byte_offset", "line_number", F.length("text").cast("long").alias("length"), F.md5("text").alias("md5"))


def dedup_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: two thirds of the events, in an event store; a batch of all, twice, leaves the other third."""
    own = events(spark, sf_dir)
    store = EventStore(spark, f"{work_folder(spark)}/store")
    store.insert(own.filter("line_number % 3 <> 0"))
    return store.new_events(own.unionByName(own)).select("event_id", "line_number")


def insert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three inserts return: some events, all events twice, all events again."""
    own, store = events(spark, sf_dir), EventStore(spark, f"{work_folder(spark)}/store")
    counts = [store.insert(x) for x in (own.filter("line_number % 3 <> 0"), own.unionByName(own), own)]
    return spark.createDataFrame(list(enumerate(counts)), "run int, inserted long")


def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as JSON lines, ingested twice into a store."""
    work = _log_file(spark, sf_dir)
    store = EventStore(spark, f"{work}/store")
    for _ in range(2):
        ingest(spark, store, f"{work}/logs", parser="jsonl")
    return _stored(store)


def tail_microbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file read by the tail stream, which takes what is there and stops, twice from one checkpoint."""
    work = _log_file(spark, sf_dir)
    store = EventStore(spark, f"{work}/store")
    for _ in range(2):
        start_tail(spark, store, f"{work}/logs/part-*", f"{work}/checkpoint", parser="jsonl", interval=None).awaitTermination()
    return _stored(store)


def ingest_then_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file ingested and then tailed from its beginning: every event is stored once."""
    work = _log_file(spark, sf_dir)
    store = EventStore(spark, f"{work}/store")
    ingest(spark, store, f"{work}/logs")
    start_tail(spark, store, f"{work}/logs/part-*", f"{work}/checkpoint", interval=None).awaitTermination()
    return _stored(store)


def _appended(spark: SparkSession, target: str, more: str) -> None:
    """Append the one part file of folder `more` to that of folder `target`, in place."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(conf)
    into, source = (system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{f}/part-*"))[0].getPath() for f in (target, more))
    raw = system.getRawFileSystem() if system.getScheme() == "file" else system  # the checksummed one cannot append
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(system.open(source), raw.append(into), 1 << 16, True)


def tail_fold(spark: SparkSession, sf_dir: str, at: int = 500) -> DataFrame:
    """Events of three lines, tailed in two batches that split one of them after its second line."""
    work = work_folder(spark)
    parts = F.posexplode(F.array(F.col("text"), F.lit("Traceback:"), F.concat(F.lit("  at line "), F.col("line_number").cast("string")))).alias("k", "text")
    lines = _text_lines(spark, sf_dir).select("line_number", parts)
    early = F.struct("line_number", "k") < F.struct(F.lit(at).cast("long").alias("line_number"), F.lit(2).alias("k"))
    _file(lines.filter(early), f"{work}/logs", "line_number", "k")
    _file(lines.filter(~early), f"{work}/later", "line_number", "k")
    store = EventStore(spark, f"{work}/store")
    for hold in (3600.0, 0.0):
        start_tail(spark, store, f"{work}/logs/part-*", f"{work}/checkpoint", interval=None, flush_after=hold).awaitTermination()
        if hold:
            _appended(spark, f"{work}/logs", f"{work}/later")
    return store.events().select("line_number", "severity", "service", "message", F.unix_micros("timestamp").alias("micros"))


def read_from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file of messages from byte 1000 on, which lies inside a line."""
    work = work_folder(spark)
    _file(events(spark, sf_dir).select("line_number", F.col("message").alias("text")), f"{work}/logs", "line_number")
    return read_lines(spark, f"{work}/logs", start_offset=1000).select("byte_offset", "line_number", "text")


def json_array_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 50 events in a JSON array, in which many items are equal; an item whose id repeats would be dropped."""
    own = events(spark, sf_dir)
    item = F.to_json(F.struct(F.col("severity").alias("level"), F.col("service").alias("msg")))
    files = own.groupBy(F.floor(F.col("line_number") / 50).cast("string").alias("source_path")).agg(F.sort_array(F.collect_list(F.struct("line_number", item.alias("item")))).alias("items"))
    files = files.select("source_path", F.concat(F.lit("[\n"), F.array_join(F.col("items.item"), " ,\n"), F.lit("]\n")).alias("content"))
    return formats.parse_json_array(files).dropDuplicates(["event_id"]).select("source_path", "line_number", "severity", "message")


def _parsed_lines(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return formats.parse_text(events(spark, sf_dir).select("source_path", "byte_offset", "line_number", text.alias("text")), formats.Source("a"))


def access_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("host", F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0100] "GET /'), "service", F.lit(' HTTP/1.1" '), F.col("status_code").cast("string"), F.lit(' 12 "-" "x"'))
    found = _parsed_lines(spark, sf_dir, text)
    return found.select("line_number", "host", "status_code", "severity", F.unix_micros("timestamp").alias("micros"), F.length("message").alias("length"), "unstructured")


def syslog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("timestamp", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("timestamp").cast("string"), 2, " "), F.date_format("timestamp", " HH:mm:ss "), "host", F.lit(" "), "service", F.lit(":  "), "message", F.lit(" "))
    return _parsed_lines(spark, sf_dir, text).select("line_number", "host", "service", "severity", "message", F.unix_micros("timestamp").alias("micros"), "unstructured")


def logger_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the logger form, and every fifth of no form."""
    form = F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" AUDIT app."), "service", F.lit(" - "), "message")
    text = F.when(F.col("line_number") % 5 == 0, F.concat(F.lit("plain "), "message")).otherwise(form)
    return _parsed_lines(spark, sf_dir, text).select("line_number", "logger", "severity", "message", "unstructured")


def text_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of JSON lines: cut after 8,000 characters, with a mark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    lines = docs.select(F.lit("/d").alias("source_path"), F.col("doc_id").alias("byte_offset"), F.col("doc_id").alias("line_number"), F.to_json(F.struct(F.col("text").alias("message"))).alias("text"))
    found = formats.parse_json(lines)
    return found.select(F.col("line_number").alias("doc_id"), F.length("message").cast("long").alias("length"), F.md5("message").alias("md5"))


def _mixed_folder(spark: SparkSession, sf_dir: str) -> tuple[EventStore, str, IngestResult]:
    """Events as JSON lines, CSV, text, access log and JSON array, a folder each, ingested with detected formats."""
    work, own = work_folder(spark), events(spark, sf_dir)
    _file(json_lines(spark, sf_dir), f"{work}/logs/lines", "line_number")
    _file(_text_lines(spark, sf_dir), f"{work}/logs/text", "line_number")
    rows = own.select("line_number", F.concat_ws(",", "severity", F.concat(F.lit('"'), "message", F.lit('"')), "service").alias("text"))
    _file(rows.unionByName(spark.createDataFrame([(-1, "level,message,service")], rows.schema)), f"{work}/logs/csv", "line_number")
    access = F.concat("host", F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET / HTTP/1.1" 200 1'))
    _file(own.select("line_number", access.alias("text")), f"{work}/logs/access", "line_number")
    items = own.filter("line_number < 100").select("line_number", F.to_json(F.struct(F.col("severity").alias("level"), F.col("message").alias("msg"))).alias("item"))
    array = items.agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.struct("line_number", "item")))["item"], ",\n"), F.lit("]")).alias("text"))
    _file(array, f"{work}/logs/array", "text")
    store = EventStore(spark, f"{work}/store")
    return store, f"{work}/logs", ingest(spark, store, f"{work}/logs/*/part-*")


def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by folder and format, with severities as parsed."""
    store, _, _ = _mixed_folder(spark, sf_dir)
    folder = F.element_at(F.split("source_path", "/"), -2)
    return store.events().groupBy(folder.alias("folder"), "raw_format", "severity").agg(F.count(F.lit(1)).alias("n"))


def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source table after a second run, one source disabled."""
    store, logs, result = _mixed_folder(spark, sf_dir)
    ingest(spark, store, f"{logs}/*/part-*")
    store.set_enabled(next(f.path for f in result.files if "/csv/" in f.path), False)
    folder = F.element_at(F.split("path", "/"), -2)
    return store.list_sources().select(folder.alias("folder"), "parser", "enabled", "total_events", "inserted_events", "unstructured_lines", "parse_errors")


def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in store and source table when two of five sources are deleted."""
    store, _, result = _mixed_folder(spark, sf_dir)
    for f in result.files:
        if "/text/" in f.path or "/access/" in f.path:
            store.delete_source(f.path)
    events_ = store.events().groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    known = store.sources().select("path", "inserted_events")
    joined = known.join(events_, F.col("path") == F.col("source_path"), "full")
    return joined.select(F.element_at(F.split(F.coalesce("path", "source_path"), "/"), -2).alias("folder"), "inserted_events", "n")


def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written by four runs, compacted."""
    own, store = events(spark, sf_dir), EventStore(spark, f"{work_folder(spark)}/store")
    for k in range(4):
        store.insert(own.filter(F.col("line_number") % 4 == k))
    store.compact(1)
    return store.events().select("event_id", "severity", F.unix_micros("timestamp").alias("micros"), F.col("event_date").cast("string").alias("day"))


def pruned_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time range over the store, whose bounds also prune its dates."""
    store = EventStore(spark, f"{work_folder(spark)}/store")
    store.insert(events(spark, sf_dir))
    found = frame(store.events(), 'ts >= "2024-01-05T22:00:00" AND ts < "2024-01-07T01:30:00+01:00" | limit 100000')
    return found.select("event_id", F.unix_micros("timestamp").alias("micros"))


def _exported(fmt: str) -> Q:
    """Errors exported and read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{work_folder(spark)}/export"
        export.export_query(events(spark, sf_dir), "", path, fmt)
        if fmt == "parquet":
            rows = spark.read.parquet(path)
        else:
            schema = "event_id string, timestamp string, severity string, message string, duration_ms double, status_code int"
            rows = spark.read.schema(schema).json(path) if fmt == "jsonl" else spark.read.option("header", True).option("escape", '"').csv(path)
        day = F.substring(F.col("timestamp").cast("string"), 1, 10)
        return rows.select("event_id", "severity", "message", F.col("duration_ms").cast("double").alias("duration_ms"), F.col("status_code").cast("int").alias("status_code"), day.alias("day"))

    return query


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session report, a row a fact; the Markdown's own table rows are counted."""
    found = export.session_report(events(spark, sf_dir), [{"severity": "INFO", "title": "a|b"}], NOW)
    read = json.loads(export.report_json(found))
    facts = [("events", "", read["events"])] + [("severity", k, v) for k, v in read["severity"].items()] + [("service", r["service"], r["count"]) for r in read["top_services"]]
    facts += [("signature", r["signature"], r["total"]) for r in read["top_error_signatures"]] + [("alerts", r["title"], 1) for r in read["alerts"]]
    lines = export.report_markdown(found).splitlines()
    facts += [("markdown", "escaped", sum("a\\|b" in x for x in lines))]
    return spark.createDataFrame([(a, b, int(c)) for a, b, c in facts], "section string, name string, value long")


def run_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules at once: a failing, a disabled and an unknown one do not stop the others. Alerts by rule, failures as -1."""
    config = rules.RuleConfig
    own = [
        config("a", "missing_heartbeat", parameters={"silence_min": 60}), config("b", "event_burst", parameters={"window_min": 1440, "baseline_min": 7200, "factor": 0.2}),
        config("c", "latency_threshold", parameters={"window_min": 60 * 24 * 60, "threshold_ms": 0.0}), config("d", "error_rate_spike", parameters={"min_errors": "many"}),
        config("e", "new_error_signature", enabled=False), config("f", "no_such_rule"),
    ]
    found = rules.run_all(events(spark, sf_dir), own, datetime(2024, 1, 31), "ws-driver")
    counts = {r: 0 for r in ("missing_heartbeat", "event_burst", "latency_threshold")}
    for alert in found.alerts:
        counts[alert["rule_id"]] += 1
    return spark.createDataFrame([*counts.items(), *((r, -1) for r in found.failures)], "rule_id string, alerts long")


def known_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New error signatures by the store's table of known ones, which three inserts and looks extend."""
    own, store = events(spark, sf_dir), EventStore(spark, f"{work_folder(spark)}/store")
    own = own.withColumn("message", F.when(F.col("line_number") % 11 == 0, F.concat("message", F.lit(" "), F.date_format("timestamp", "EEEE"), F.lit(" "), "service")).otherwise(F.col("message")))
    for k in range(3):
        store.insert(own.filter(F.col("line_number") % 3 == k))
        store.known_signatures()
    config = rules.RuleConfig("n", "new_error_signature", parameters={"window_min": 60 * 24 * 16})
    found = rules.new_signatures(rules.Context(store.events(), config, NOW, known=store.known_signatures()))
    return found.select("signature", F.unix_micros("first_seen").alias("micros"))


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(analytics.severity_counts(events(spark, sf_dir)).items()), "severity string, n long")


#: Queries, and what is wrong with them: the beginning of the message.
WRONG = {
    "level = ERROR | stats count() by service": "ok", "duration_ms > NULL": "Cannot use > with NULL", "severty = ERROR": "Unknown field: severty\nDid you mean: severity?", "zzz = 1": "Unknown field: zzz", "duration_ms > fast": "'fast' cannot be compared",
    "duration_ms CONTAINS 5": "", "| stats sum(message)": "sum needs a number field", "| stats count() by service | sort message": "Cannot sort by message", "NULL": "NULL is not a condition", "level =": "", "ts > yesterday": "'yesterday' cannot be compared",
}


def query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries checked without running: whether they are fine, and whether the message is the expected one."""
    found = [(q, *validate(q)) for q in WRONG]
    return spark.createDataFrame([(q, ok, m.startswith(WRONG[q])) for q, ok, m in found], "query string, ok boolean, expected boolean")


def literal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of other types than their columns: rows of each query, -1 where it is an error."""
    own, counts = events(spark, sf_dir), []
    for text in ('status = "500"', "status = 500.0", "status = TRUE", 'duration_ms >= "1e1"', "message = 5", 'line_number IN ("7", 8)', 'status = "5xx"', 'ts = "2024"', "trace_id = TRUE"):
        try:
            counts.append((text, frame(own, f"{text} | stats count()").first()[0]))
        except QueryError:
            counts.append((text, -1))
    return spark.createDataFrame(counts, "query string, n long")


def display_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display(frame(events(spark, sf_dir), "level = ERROR | limit 30")).drop("Logger", "Exception").select("Level", "Service", "Status", "Line", "Path", "`Duration (ms)`", "`Event ID`")


_STORED = EV + "SELECT severity, message, trace_id, duration_ms, status_code, epoch_us(timestamp) AS micros, row_number() OVER (ORDER BY line_number) AS line_number FROM ev"
_FOLDERS = EV + """, a AS (SELECT 'lines' AS folder, 'json' AS raw_format, 'jsonl' AS parser, severity FROM ev UNION ALL SELECT 'text', 'text', 'text', severity FROM ev UNION ALL SELECT 'csv', 'csv', 'csv', severity FROM ev
  UNION ALL SELECT 'access', 'text', 'text', 'UNKNOWN' FROM ev UNION ALL SELECT 'array', 'json', 'jsonarray', severity FROM ev WHERE line_number < 100) """
_EXPORTED = EV + "SELECT event_id, severity, message, duration_ms, status_code, strftime(timestamp, '%Y-%m-%d') AS day FROM ev WHERE severity = 'ERROR'"

QUERIES: dict[str, tuple[Q, str | None]] = {
    "multiline_fold": (multiline_fold, r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS source_path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
      m AS (SELECT source_path, CAST(k AS BIGINT) AS k, regexp_matches(t, '^[A-M]') AS head, CASE WHEN regexp_matches(t, '^[A-M]') THEN '2024-01-01 00:00:00 INFO ' || t ELSE '  ' || t END AS t FROM l),
      g AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY source_path ORDER BY k) AS e FROM m), j AS (SELECT source_path, min(k) AS byte_offset, min(k) + 1 AS line_number, string_agg(t, chr(10) ORDER BY k) AS t FROM g GROUP BY source_path, e)
      SELECT source_path, byte_offset, line_number, length(t) AS length, md5(t) AS md5 FROM j"""),
    "dedup_append": (dedup_append, f"{EV} SELECT event_id, line_number FROM ev WHERE line_number % 3 = 0"),
    "insert_counts": (insert_counts, f"{EV} SELECT 0 AS run, count(*) FILTER (line_number % 3 <> 0) AS inserted FROM ev UNION ALL SELECT 1, count(*) FILTER (line_number % 3 = 0) FROM ev UNION ALL SELECT 2, CAST(0 AS BIGINT) FROM ev WHERE line_number = 5"),
    "ingest_files": (ingest_files, _STORED), "tail_microbatch": (tail_microbatch, _STORED), "ingest_then_tail": (ingest_then_tail, _STORED),
    "tail_fold": (tail_fold, EV + "SELECT 3 * row_number() OVER (ORDER BY line_number) - 2 AS line_number, severity, service, message || chr(10) || 'Traceback:' || chr(10) || '  at line ' || line_number AS message, epoch_us(timestamp) AS micros FROM ev"),
    "read_from_offset": (read_from_offset, EV + """, l AS (SELECT message, line_number AS n, sum(length(message) + 1) OVER (ORDER BY line_number) AS next FROM ev), k AS (SELECT *, next - length(message) - 1 AS place FROM l WHERE next > 1000)
      SELECT CAST(greatest(place, 1000) AS BIGINT) AS byte_offset, row_number() OVER (ORDER BY n) AS line_number, substr(message, CAST(greatest(1000 - place, 0) + 1 AS BIGINT)) AS text FROM k"""),
    "json_array_parse": (json_array_parse, EV + "SELECT CAST(line_number // 50 AS VARCHAR) AS source_path, row_number() OVER (PARTITION BY line_number // 50 ORDER BY line_number) AS line_number, severity, service AS message FROM ev"),
    "access_parse": (access_parse, EV + """SELECT line_number, host, status_code, 'UNKNOWN' AS severity, epoch_us(date_trunc('second', timestamp)) - 3600000000 AS micros,
      CAST(length(host || ' - - [05/Jan/2024:00:00:00 +0100] "GET /' || service || ' HTTP/1.1" 200 12 "-" "x"') AS INT) AS length, false AS unstructured FROM ev"""),
    "syslog_parse": (syslog_parse, EV + "SELECT line_number, host, service, 'UNKNOWN' AS severity, message, epoch_us(make_timestamp(1900, month(timestamp), day(timestamp), hour(timestamp), minute(timestamp), CAST(second(timestamp) AS DOUBLE))) AS micros, false AS unstructured FROM ev"),
    "logger_parse": (logger_parse, EV + "SELECT line_number, CASE WHEN line_number % 5 <> 0 THEN 'app.' || service END AS logger, CASE WHEN line_number % 5 <> 0 THEN 'AUDIT' ELSE 'UNKNOWN' END AS severity, CASE WHEN line_number % 5 <> 0 THEN message ELSE 'plain ' || message END AS message, line_number % 5 = 0 AS unstructured FROM ev"),
    "text_truncation": (text_truncation, "SELECT doc_id, length(m) AS length, md5(m) AS md5 FROM (SELECT doc_id, CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || '...' ELSE text END AS m FROM documents WHERE text IS NOT NULL)"),
    "detect_formats": (detect_formats, _FOLDERS + "SELECT folder, raw_format, severity, count(*) AS n FROM a GROUP BY ALL"),
    "source_table": (source_table, _FOLDERS + "SELECT folder, parser, folder <> 'csv' AS enabled, 2 * count(*) AS total_events, count(*) AS inserted_events, CAST(0 AS BIGINT) AS unstructured_lines, CAST(0 AS BIGINT) AS parse_errors FROM a GROUP BY folder, parser"),
    "delete_source": (delete_source, _FOLDERS + "SELECT folder, count(*) AS inserted_events, count(*) AS n FROM a WHERE folder NOT IN ('text', 'access') GROUP BY folder"),
    "compacted_store": (compacted_store, EV + "SELECT event_id, severity, epoch_us(timestamp) AS micros, strftime(timestamp, '%Y-%m-%d') AS day FROM ev"),
    "pruned_by_date": (pruned_by_date, EV + "SELECT event_id, epoch_us(timestamp) AS micros FROM ev WHERE timestamp >= TIMESTAMP '2024-01-05 22:00:00' AND timestamp < TIMESTAMP '2024-01-07 00:30:00' ORDER BY timestamp, line_number LIMIT 100000"),
    **{f"export_{fmt}": (_exported(fmt), _EXPORTED) for fmt in export.FORMATS},
    "report": (report, EV + f"""SELECT 'events' AS section, '' AS name, count(*) AS value FROM ev UNION ALL SELECT 'severity', severity, count(*) FROM ev GROUP BY severity UNION ALL SELECT 'service', service, count(*) FROM ev GROUP BY service
      UNION ALL SELECT 'signature', {sig('message')}, count(*) FROM ev WHERE severity = 'ERROR' GROUP BY 2 UNION ALL SELECT 'alerts', 'a|b', 1 UNION ALL SELECT 'markdown', 'escaped', 1"""),
    "run_all_rules": (run_all_rules, EV + """SELECT 'missing_heartbeat' AS rule_id, count(*) AS alerts FROM (SELECT service FROM ev GROUP BY service HAVING max(timestamp) < TIMESTAMP '2024-01-30 23:00:00')
      UNION ALL SELECT 'event_burst', count(*) FROM (SELECT count(*) FILTER (timestamp >= TIMESTAMP '2024-01-30') AS r, count(*) FILTER (timestamp < TIMESTAMP '2024-01-30') AS b FROM ev WHERE timestamp >= TIMESTAMP '2024-01-25' AND timestamp < TIMESTAMP '2024-01-31') WHERE b > 0 AND r >= b * 0.2 * 0.2
      UNION ALL SELECT 'latency_threshold', count(*) FROM (SELECT service FROM ev WHERE duration_ms IS NOT NULL GROUP BY service HAVING count(*) >= 5) UNION ALL SELECT 'error_rate_spike', -1"""),
    "known_signatures": (known_signatures, EV + f"""SELECT {sig("(CASE WHEN line_number % 11 = 0 THEN message || ' ' || dayname(timestamp) || ' ' || service ELSE message END)")} AS signature, epoch_us(min(timestamp)) AS micros
      FROM ev WHERE severity IN ('ERROR', 'FATAL', 'CRITICAL') GROUP BY 1 HAVING min(timestamp) >= TIMESTAMP '2024-01-04' ORDER BY 2, 1 LIMIT 50"""),
    "severity_counts": (severity_counts, f"{EV} SELECT severity, count(*) AS n FROM ev GROUP BY severity"),
    "fetch_by_correlation": (lambda s, d: analytics.fetch_by_correlation(events(s, d), "t3", None, "s11").drop("span_id", "parent_span_id"), f"{EV} SELECT event_id, source_alias, source_path, line_number, timestamp, severity, message, service, trace_id, request_id, session_id, duration_ms, status_code FROM ev WHERE trace_id = 't3' OR session_id = 's11'"),
    "source_summary": (lambda s, d: analytics.source_summary(events(s, d)), f"{EV} SELECT source_path, max(source_alias) AS source_alias, count(*) AS events, count(*) FILTER (severity = 'ERROR') AS errors, min(timestamp) AS first_event, max(timestamp) AS last_event FROM ev GROUP BY source_path"),
    "query_errors": (query_errors, "SELECT unnest([" + ", ".join("'" + q.replace("'", "''") + "'" for q in WRONG) + "]) AS query, unnest([" + ", ".join(str(m == "ok").lower() for m in WRONG.values()) + "]) AS ok, true AS expected"),
    "literal_types": (literal_types, EV + """SELECT 'status = "500"' AS query, count(*) FILTER (status_code = 500) AS n FROM ev UNION ALL SELECT 'status = 500.0', count(*) FILTER (status_code = 500) FROM ev UNION ALL SELECT 'status = TRUE', count(*) FILTER (status_code = 1) FROM ev
      UNION ALL SELECT 'duration_ms >= "1e1"', count(*) FILTER (duration_ms >= 10) FROM ev UNION ALL SELECT 'message = 5', count(*) FILTER (message = '5') FROM ev UNION ALL SELECT 'line_number IN ("7", 8)', count(*) FILTER (line_number IN (7, 8)) FROM ev
      UNION ALL SELECT 'status = "5xx"', -1 UNION ALL SELECT 'ts = "2024"', -1 UNION ALL SELECT 'trace_id = TRUE', count(*) FILTER (trace_id = 'true') FROM ev"""),
    "display_columns": (display_columns, EV + 'SELECT severity AS "Level", service AS "Service", status_code AS "Status", line_number AS "Line", source_path AS "Path", duration_ms AS "Duration (ms)", event_id AS "Event ID" FROM ev WHERE severity = \'ERROR\' ORDER BY timestamp, line_number LIMIT 30'),
}
