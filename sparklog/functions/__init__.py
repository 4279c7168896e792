"""Column functions: severities, error signatures, time buckets, timestamps, paths, event ids. No UDFs.

Times are UTC whatever the session's zone is: what has no offset is read as UTC, days and buckets are those of UTC.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.schema import ERRORS, SEVERITY_ALIASES, WARNINGS

# The format of event ids.
EVENT_ID_PREFIX, EVENT_ID_DIGITS, CONTENT_DIGITS = "tfevt-", 24, 16
RESOLUTIONS = {"second": "1 second", "minute": "1 minute", "five_minutes": "5 minutes", "hour": "1 hour", "day": "1 day"}
DAY = 86_400_000_000  # microseconds
#: Signature steps: pattern, replacement. Fixed values, applied in this order.
SIGNATURE_STEPS = (
    (r"\x1B\[[0-?]*[ -/]*[@-~]", ""),
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"0x[0-9a-fA-F]+", "<addr>"),
    (r"(?<![0-9A-Fa-f\p{L}])[0-9A-Fa-f]{16,}(?![0-9A-Fa-f\p{L}])", "<hex>"),
    (r"\d+\.\d+", "<num>"),
    (r"(?<![\p{L}\p{N}_])\p{Nd}{2,}", "<num>"),
    (r'File "[^"]+", line \d+', "File <path>"),
    (r'"[^"\n]{6,}"', '"<str>"'),
    (r"(?<![\p{L}\p{N}_\-])[\p{L}\p{N}_\-]{16,}", "<id>"),  # a run is maximal; the look-behind saves tries inside it
    (r"\s+", " "),
)
SIGNATURE_LENGTH = 240
#: Timestamp patterns of text logs (Spark's letters) and what is appended to the text; a yearless one falls in 1900.
TEXT_TIMESTAMPS = (("yyyy/MM/dd HH:mm:ss Z", " +0000"), ("dd/MMM/yyyy:HH:mm:ss Z", ""))
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def severity_of(level: Column) -> Column:
    """Canonical severity: trimmed, upper case, aliases mapped; blank or null is UNKNOWN, other names stay."""
    name = F.upper(F.trim(level))
    known = F.coalesce(F.create_map(*[F.lit(x) for pair in SEVERITY_ALIASES.items() for x in pair])[name], name)
    return F.when(name.isNull() | (name == ""), "UNKNOWN").otherwise(known)


def is_error(severity: str | Column = "severity") -> Column:
    return (F.col(severity) if isinstance(severity, str) else severity).isin(*ERRORS)


def is_warning(severity: str | Column = "severity") -> Column:
    return (F.col(severity) if isinstance(severity, str) else severity).isin(*WARNINGS)


def signature(message: Column, length: int = SIGNATURE_LENGTH) -> Column:
    """The message with its changing parts (times, ids, numbers, quoted text) replaced by placeholders."""
    out = F.coalesce(message, F.lit(""))
    for pattern, replacement in SIGNATURE_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.trim(out)
    return F.when(F.char_length(out) > length, F.concat(F.substring(out, 1, length), F.lit("..."))).otherwise(out)


def bucket(time: Column, resolution: str) -> Column:
    """Start of the time's bucket, counted from 1970 in UTC; in the time's own type. Rows without a time are left out."""
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution!r}; known: {', '.join(RESOLUTIONS)}")
    return F.window(time, RESOLUTIONS[resolution]).start


def moment(when: datetime, kind: T.DataType) -> Column:
    """A literal to compare a column of the type with; a time without an offset is UTC."""
    utc = when.astimezone(UTC) if when.tzinfo else when.replace(tzinfo=UTC)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(utc.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit((utc - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)))


def as_utc(time: Column, kind: T.DataType) -> Column:
    """A time as a timestamp; one of a type without zone is UTC."""
    return F.concat(time.cast("string"), F.lit("Z")).cast("timestamp") if isinstance(kind, T.TimestampNTZType) else time


def utc_date(time: Column) -> Column:
    """The day of a timestamp in UTC."""
    micros = F.unix_micros(time)
    return F.date_from_unix_date(((micros - F.pmod(micros, F.lit(DAY))) / DAY).cast("int"))


def utc_text(time: Column) -> Column:
    """A timestamp as ISO text in UTC, to the microsecond."""
    rest = F.pmod(F.unix_micros(time), F.lit(DAY))
    parts = [F.floor(rest / n) % k for n, k in ((3_600_000_000, 24), (60_000_000, 60), (1_000_000, 60))]
    return F.format_string("%sT%02d:%02d:%02d.%06d", utc_date(time).cast("string"), *parts, rest % 1_000_000)


def iso_timestamp(text: Column) -> Column:
    """An ISO 8601 date or date and time, in UTC where it has no offset; null if it is none."""
    own = F.regexp_replace(F.trim(text), ",(\\d)", ".$1")
    for _ in range(2):  # a time without minutes, then one without seconds
        own = F.regexp_replace(own, r"^(.{10}[T ]\d{2}(?::\d{2})?)(?=$|Z|[+-])", "$1:00")
    zoned = F.when(F.char_length(own) == 10, F.concat(own, F.lit("T00:00:00Z"))).when(own.rlike(r"[T ].*(Z|[+-]\d{2}(:?\d{2})?)$"), own).otherwise(F.concat(own, F.lit("Z")))
    return F.when(F.trim(text).rlike(ISO), zoned.try_cast("timestamp"))


def epoch_timestamp(number: Column) -> Column:
    """Microseconds above 1e15, milliseconds above 1e12, else seconds since 1970."""
    value = number.cast("double")
    micros = F.when(value > 1e15, value).when(value > 1e12, value * 1e3).otherwise(value * 1e6)
    return F.timestamp_micros(F.round(micros).try_cast("long"))


def text_timestamp(text: Column) -> Column:
    """A text log's timestamp: slashed dates, access-log and syslog forms, else ISO 8601; in UTC where it has no offset."""
    own = F.regexp_replace(F.trim(text), r"\s+", " ")
    forms = [F.try_to_timestamp(F.concat(own, F.lit(more)), F.lit(f)) for f, more in TEXT_TIMESTAMPS]
    yearless = F.try_to_timestamp(F.concat(F.lit("1900 "), own, F.lit(" +0000")), F.lit("yyyy MMM d HH:mm:ss Z"))
    syslog = F.when(own.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}$"), yearless)
    return F.coalesce(iso_timestamp(text), *forms, syslog)


def source_path(uri: Column, encoded: bool = True) -> Column:
    """A file's path as event ids have it: without the scheme of local files, and without URI escapes."""
    plain = F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri) if encoded else uri
    return F.regexp_replace(plain, "^file:/+", "/")


def event_id(path: Column, raw: Column, byte_offset: Column, line_number: Column) -> Column:
    """A stable id of the source path, the position (byte offset, else line) and the raw content."""
    position = (
        F.when(byte_offset >= 0, F.concat(F.lit("@"), byte_offset.cast("string"))).when(line_number > 0, F.concat(F.lit("L"), line_number.cast("string"))).otherwise("@?")
    )
    content = F.substring(F.sha1(raw), 1, CONTENT_DIGITS)
    return F.concat(F.lit(EVENT_ID_PREFIX), F.substring(F.sha1(F.concat_ws("|", path, position, content)), 1, EVENT_ID_DIGITS))
