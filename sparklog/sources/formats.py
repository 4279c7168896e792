"""Parsers of line formats: a DataFrame of lines in, one of events out, in Spark functions (places of array items apart).

Every parser keeps all non-blank lines: what it cannot parse becomes an event of severity UNKNOWN with `unstructured`
true. Results have the event columns and `unstructured`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.functions import epoch_timestamp, event_id, iso_timestamp, moment, severity_of, text_timestamp
from sparklog.schema import EVENT_COLUMNS

MAX_MESSAGE = 8000
#: Strings (of either quotes, as Spark reads both), brackets, commas and other values.
JSON_TOKEN = re.compile(r"""(?s)"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[\[\]{},]|[^\s\[\]{},:"']+""")

# Keys of structured logs by event column, the first that has a value counts.
KEYS = {
    "timestamp": ("timestamp", "time", "ts", "@timestamp", "datetime", "date", "event_time"),
    "severity": ("level", "severity", "log.level", "loglevel", "log_level", "levelname"),
    "message": ("message", "msg", "log", "log.message", "event", "text"),
    "service": ("service", "service_name", "service.name", "app", "application", "logger_name", "component"),
    "logger": ("logger", "logger_name", "logger.name"),
    "host": ("host", "hostname", "host.name", "server", "server_name"),
    "process": ("process", "process.name", "pid", "process_name"),
    "thread": ("thread", "thread.name", "thread_name", "thread_id"),
    "trace_id": ("trace_id", "traceId", "trace.id", "traceID"),
    "span_id": ("span_id", "spanId", "span.id", "spanID"),
    "parent_span_id": ("parent_span_id", "parentSpanId", "parent_span", "parentSpan"),
    "request_id": ("request_id", "requestId", "request.id", "requestID", "correlation_id", "correlationId"),
    "session_id": ("session_id", "sessionId", "session.id", "sessionID"),
    "duration_ms": ("duration_ms", "duration", "latency_ms", "elapsed_ms", "response_time_ms"),
    "status_code": ("status_code", "status", "http.status_code", "http_status", "code"),
    "exception_type": ("exception_type", "exception", "error_type", "error.kind"),
}
KNOWN = sorted({k for keys in KEYS.values() for k in keys})


@dataclass(frozen=True)
class Form:
    """A text line's form: a Java pattern, and the number of the group of each part."""

    name: str
    pattern: str
    groups: dict[str, int]


# Forms of text lines, the first that matches counts.
TEXT_FORMS = (
    Form("iso", r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\s*(?:\[([^\]]+)\]\s*)?(.*)$", {"timestamp": 1, "level": 2, "service": 3, "message": 4}),
    Form("bracketed", r"^\s*\[(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\]\s*\[([A-Z]+)\]\s*(.*)$", {"timestamp": 1, "level": 2, "message": 3}),
    Form("syslog", r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s*(.*)$", {"timestamp": 1, "host": 2, "service": 3, "message": 4}),
    Form("access", r"""^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"[A-Z]+\s+\S+\s+HTTP/[\d.]+"\s+(\d{3})\s+\S+\s*(?:"[^"]*"\s*)?(?:"[^"]*"\s*)?""", {"host": 1, "timestamp": 2, "status": 3}),
    Form("logger", r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+([A-Z]+)\s+(\S+)\s+-\s+(.*)$", {"timestamp": 1, "level": 2, "logger": 3, "message": 4}),
)


@dataclass(frozen=True)
class Source:
    """What a parser needs to know of where its lines come from."""

    alias: str = ""
    source_id: int = 0
    ingested_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    regex: str | None = None
    field_map: dict[str, str] = field(default_factory=dict)


def _events(lines: DataFrame, source: Source, raw_format: str, raw: Column, columns: dict[str, Column], unstructured: Column) -> DataFrame:
    """Event rows: given columns, positions of the lines, the rest null. raw: what the event id hashes."""
    fixed = {
        "event_id": event_id(F.col("source_path"), raw, F.col("byte_offset"), F.col("line_number")), "source_id": F.lit(source.source_id).cast("long"),
        "source_alias": F.when(F.lit(source.alias == ""), F.element_at(F.split("source_path", "/"), -1)).otherwise(source.alias), "source_path": F.col("source_path"),
        "line_number": F.col("line_number"), "byte_offset": F.col("byte_offset"), "raw_format": F.lit(raw_format), "ingested_at": moment(source.ingested_at, T.TimestampType()),
    }
    kinds = {"timestamp": "timestamp", "duration_ms": "double", "status_code": "int"}
    rest = {c: F.lit(None).cast(kinds.get(c, "string")) for c in EVENT_COLUMNS}
    values = rest | fixed | columns
    return lines.select(*[values[c].alias(c) for c in EVENT_COLUMNS], unstructured.alias("unstructured"))


def _shown(text: Column, mark: str = "") -> Column:
    return F.when(F.char_length(text) > MAX_MESSAGE, F.concat(F.substring(text, 1, MAX_MESSAGE), F.lit(mark))).otherwise(text)


def _unknown_message(text: Column) -> Column:
    """The first characters of a line; a line that was cut keeps its mark."""
    cut, shown = text.endswith("...[truncated]"), F.substring(text, 1, MAX_MESSAGE)
    return F.when(cut & ~shown.contains("[truncated]"), F.concat(F.rtrim(shown), F.lit("...[truncated]"))).otherwise(shown)


def _nested(column: str) -> list[str]:
    return [k for k in KEYS[column] if "." in k]


def _value(column: str) -> Column:
    """First value of the column's keys, as text: top-level ones, then dotted ones as nested keys."""
    flat = [F.try_element_at("entries", F.lit(k)) for k in KEYS[column]]
    return F.coalesce(*flat, *[F.try_variant_get("document", f"$.{k}", "string") for k in _nested(column)])


def _is_text(column: str) -> Column:
    """Whether the first value of the column's keys is a JSON string."""
    found = F.lit(False)
    for k in reversed(KEYS[column]):
        kind = F.schema_of_variant(F.try_variant_get("document", f"$['{k}']", "variant"))
        found = F.when(F.try_element_at("entries", F.lit(k)).isNotNull(), kind == "STRING").otherwise(found)
    return found


def parse_json(lines: DataFrame, source: Source = Source()) -> DataFrame:  # noqa: B008
    """JSON lines: an object a line; blank lines are skipped, others that are no object are unstructured."""
    text = F.col("text")
    rows = lines.filter(F.trim("text") != "").withColumns({"document": F.try_parse_json("text"), "entries": F.from_json("text", "map<string,string>")})
    rows = rows.withColumn("is_object", F.col("document").isNotNull() & F.ltrim("text").startswith("{") & F.col("entries").isNotNull())
    rows = rows.withColumns({f"v_{c}": F.when(F.col("is_object"), _value(c)) for c in KEYS})
    v, is_object = {c: F.col(f"v_{c}") for c in KEYS}, F.col("is_object")
    number = F.when(v["timestamp"].rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.when(~_is_text("timestamp"), epoch_timestamp(v["timestamp"].try_cast("double"))))
    tail = F.to_json(F.map_filter("entries", lambda k, _: ~k.isin(*KNOWN)))
    columns = v | {
        "timestamp": F.coalesce(number, iso_timestamp(v["timestamp"])), "severity": F.when(is_object, severity_of(v["severity"])).otherwise("UNKNOWN"),
        "message": F.when(is_object, _shown(F.coalesce(v["message"], text), "...")).otherwise(_unknown_message(text)), "raw_text": text, "duration_ms": v["duration_ms"].try_cast("double"),
        "status_code": v["status_code"].try_cast("double").try_cast("int"), "attributes_json": F.when(is_object, tail),
    }
    return _events(rows, source, "json", text, columns, ~is_object)


def parse_json_array(files: DataFrame, source: Source = Source(), most: int = 64 << 20) -> DataFrame:  # noqa: B008
    """files(source_path, content as text): each an array of objects, parsed like JSON lines; items that are no object are skipped.

    Files above `most` bytes or that hold no array give no events; see array_problems(). An item's line is its rank in
    the array, its offset the character at which it begins in the file (as in the reference), so equal items differ.
    """
    fine = files.filter((F.octet_length("content") <= most) & F.trim("content").startswith("["))
    walked = fine.select("source_path", "content").mapInArrow(_walked, "source_path string, content string, places array<long>")
    items = walked.select("source_path", "places", F.posexplode(F.from_json("content", "array<string>")).alias("rank", "text"))
    items = items.filter(F.trim("text").startswith("{"))
    # Without a place (an array that only Spark's parser can read) the line stands in the event id.
    return parse_json(items.select("source_path", F.get("places", F.col("rank")).alias("byte_offset"), (F.col("rank") + 1).cast("long").alias("line_number"), "text"), source)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # a file each
            one = batch.slice(k, 1)
            places = pa.array([item_places(one.column(1)[0].as_py())], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), places], names=["source_path", "content", "places"])


def item_places(text: str) -> list[int]:
    """The character at which each item of a JSON array begins."""
    places, depth, due = [], 0, False
    for found in JSON_TOKEN.finditer(text):
        first = text[found.start()]
        if due and first not in ",]}":
            places.append(found.start())
            due = False
        if first in "[{":
            depth += 1
            due = due or depth == 1
        elif first in "]}":
            depth -= 1
            if depth == 0:
                break
        elif first == "," and depth == 1:
            due = True
    return places


def array_problems(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """source_path and problem of JSON array files that give no events; a null content stands for one above `most` bytes."""
    items = F.from_json("content", "array<string>")
    problem = F.when(F.col("content").isNull() | (F.octet_length("content") > most), f"file is larger than {most} bytes").when(~F.trim("content").startswith("["), "not a JSON array").when(items.isNull(), "invalid JSON")
    return files.select("source_path", problem.alias("problem")).filter("problem is not null")


def parse_csv(lines: DataFrame, header: list[str], source: Source = Source()) -> DataFrame:  # noqa: B008
    """CSV lines after the header, each parsed alone; short rows have nulls, further cells are dropped."""
    rows = lines.filter(F.col("text") != "")
    rows = rows.withColumn("cells", csv_cells(F.col("text")))
    by_name = {name: F.get("cells", k) for k, name in enumerate(header)}

    def first(column: str) -> Column:
        found = [by_name[k] for k in KEYS[column] if k in by_name]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    raw = F.array_join("cells", ",")
    other = {k: v for k, v in by_name.items() if k not in KNOWN}
    tail = F.to_json(F.struct(*[v.alias(k) for k, v in other.items()]), {"ignoreNullFields": "false"}) if other else F.lit("{}")
    columns = {c: first(c) for c in KEYS} | {
        "timestamp": iso_timestamp(first("timestamp")), "severity": severity_of(first("severity")), "message": F.substring(F.coalesce(first("message"), raw), 1, MAX_MESSAGE), "raw_text": raw,
        "duration_ms": F.trim(first("duration_ms")).try_cast("double"), "status_code": F.when(F.trim(first("status_code")).rlike(r"^[+-]?\d+$"), F.trim(first("status_code")).try_cast("int")), "attributes_json": tail,
    }
    return _events(rows, source, "csv", raw, columns, F.lit(False))


def csv_cells(text: Column) -> Column:
    """Cells of one CSV line: quoted cells may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',("(?:[^"]|"")*"?[^,]*|[^,]*)'), F.lit(1))
    return F.transform(cells, lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, r'^"((?:[^"]|"")*)"?', "$1"), '""', '"')).otherwise(c))


def parse_text(events: DataFrame, source: Source = Source()) -> DataFrame:  # noqa: B008
    """Text lines, folded or not: the first form that matches; others are unstructured."""
    text, form = F.col("text"), F.lit(-1)
    for k in reversed(range(len(TEXT_FORMS))):
        form = F.when(text.rlike(f"(?s){TEXT_FORMS[k].pattern}"), k).otherwise(form)
    rows = events.withColumn("form", form)

    def part(name: str) -> Column:
        out = F.lit(None).cast("string")
        for k, f in enumerate(TEXT_FORMS):
            if name in f.groups:
                out = F.when(F.col("form") == k, F.regexp_extract(text, f"(?s){f.pattern}", f.groups[name])).otherwise(out)
        return out

    names = ("timestamp", "level", "service", "host", "logger", "status", "message")
    rows = rows.withColumns({f"p_{n}": part(n) for n in names})
    p = {n: F.when(F.col(f"p_{n}") != "", F.col(f"p_{n}")) for n in names}
    hit = F.col("form") >= 0
    trimmed = F.regexp_replace(F.coalesce(p["message"], text), r"^\s+|\s+$", "")
    columns = {
        "timestamp": text_timestamp(p["timestamp"]), "severity": F.when(hit, severity_of(p["level"])).otherwise("UNKNOWN"), "message": F.when(hit, F.substring(trimmed, 1, MAX_MESSAGE)).otherwise(_unknown_message(text)),
        "raw_text": text, "service": F.trim(p["service"]), "host": p["host"], "logger": p["logger"], "status_code": p["status"].try_cast("int"),
    }
    return _events(rows, source, "text", text, columns, ~hit)


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern as a Java one, in which groups are called by their numbers (g1, g2, ...), and the numbers of its named groups.

    Raises re.error where Python cannot compile it.
    """
    numbers = dict(re.compile(pattern).groupindex)

    def renamed(found: re.Match[str]) -> str:
        if found["named"]:
            return f"(?<g{numbers[found['named']]}>"
        return rf"\k<g{numbers[found['back']]}>" if found["back"] else found[0]

    return re.sub(r"\\.|\(\?P<(?P<named>\w+)>|\(\?P=(?P<back>\w+)\)", renamed, pattern, flags=re.DOTALL), numbers


def _compiles(lines: DataFrame, pattern: str) -> bool:
    """Whether Java, which runs the pattern, can compile it."""
    try:
        lines.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def parse_regex(lines: DataFrame, source: Source) -> DataFrame:
    """Lines by a regular expression with named groups (found anywhere) and a map of event fields to groups.

    Without an expression there are no events; with one that Python or Java cannot compile, or where it does not match,
    lines are unstructured.
    """
    text = F.col("text")
    if not source.regex:
        return _events(lines.limit(0), source, "regex", text, {"severity": F.lit("UNKNOWN"), "message": text, "raw_text": text}, F.lit(True))
    columns = {"severity": F.lit("UNKNOWN"), "message": F.substring(text, 1, MAX_MESSAGE), "raw_text": text}
    try:
        pattern, groups = java_pattern(source.regex)
    except re.error:
        pattern, groups = "[", {}
    if not _compiles(lines, pattern):
        return _events(lines, source, "regex", text, columns, F.lit(True))
    hit = text.rlike(pattern)

    def part(name: str) -> Column | None:
        group = groups.get(source.field_map.get(name, ""))
        return None if group is None else F.when(hit, F.regexp_extract(text, pattern, group))

    makers: dict[str, tuple[str, Callable[[Column], Column]]] = {
        "timestamp": ("timestamp", text_timestamp), "level": ("severity", severity_of), "message": ("message", lambda c: F.substring(F.coalesce(c, text), 1, MAX_MESSAGE)), "service": ("service", lambda c: c),
        "request_id": ("request_id", lambda c: c), "trace_id": ("trace_id", lambda c: c), "duration_ms": ("duration_ms", lambda c: c.try_cast("long").cast("double")), "status_code": ("status_code", lambda c: c.try_cast("int")),
    }
    for name, (column, make) in makers.items():
        value = part(name)
        if value is not None:
            columns[column] = make(value)
    return _events(lines, source, "regex", text, columns, ~hit)
