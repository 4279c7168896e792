"""Exports of query results (JSON lines, CSV, Parquet) and session reports (JSON, Markdown)."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.operators import analytics
from sparklog.operators.query import frame
from sparklog.schema import ERRORS

FORMATS = ("jsonl", "csv", "parquet")
ERRORS_QUERY = f"severity IN ({', '.join(ERRORS)})"


def export(rows: DataFrame, path: str, fmt: str, mode: str = "error") -> None:
    """Write rows as a folder of files; times keep their type in Parquet and are ISO texts elsewhere."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format {fmt!r}; known: {', '.join(FORMATS)}")
    if fmt == "parquet":
        rows.write.mode(mode).parquet(path)
        return
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    flat = rows.select(*[F.to_json(f.name).alias(f.name) if fmt == "csv" and isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(f"`{f.name}`") for f in rows.schema])
    writer = flat.write.mode(mode).option("timestampFormat", f"{stamp}XXX").option("timestampNTZFormat", stamp)
    writer.option("ignoreNullFields", "false").json(path) if fmt == "jsonl" else writer.option("header", True).option("escape", '"').csv(path)


def export_query(events: DataFrame, query: str, path: str, fmt: str, base_limit: int | None = None, mode: str = "error") -> None:
    """Write all rows of a query, or as many as it or base_limit names."""
    export(frame(events, query or ERRORS_QUERY, base_limit=base_limit, max_limit=None), path, fmt, mode)


def session_report(events: DataFrame, alerts: list[dict[str, Any]] | None = None, now: datetime | None = None) -> dict[str, Any]:
    """Counts, time range, 100 sources of most events, severities, top 10 services, top 20 error signatures, alerts. All lists are bounded."""
    total = analytics.overview(events).first()
    return {
        "generated_at": (now or datetime.now(UTC)).isoformat(),
        "events": total["events"],
        "time_range": {"start": _iso(total["first_event"]), "end": _iso(total["last_event"])},
        "sources": [r.asDict() | {"first_event": _iso(r["first_event"]), "last_event": _iso(r["last_event"])} for r in analytics.source_summary(events).orderBy(F.desc("events"), "source_path").limit(100).collect()],
        "severity": analytics.severity_counts(events),
        "top_services": [r.asDict() for r in analytics.top_services(events, 10).collect()],
        "top_error_signatures": [r.asDict() | {"first_seen": _iso(r["first_seen"]), "last_seen": _iso(r["last_seen"])} for r in analytics.top_error_signatures(events, 20).collect()],
        "alerts": alerts or [],
    }


def _iso(when: datetime | None) -> str | None:
    return when.isoformat() if when else None


def report_json(report: dict[str, Any]) -> str:
    return json.dumps(report, indent=2, default=str, ensure_ascii=False)


def report_markdown(report: dict[str, Any]) -> str:
    """The report with 10 signatures of 60 characters each; pipes are escaped."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["# Session report", "", f"Generated {report['generated_at']}", "", f"Events: {report['events']}", f"From {report['time_range']['start']} to {report['time_range']['end']}"]
    tables = [
        ("Sources", ("Source", "Events"), [(r["source_alias"], r["events"]) for r in report["sources"]]),
        ("Severity", ("Severity", "Events"), list(report["severity"].items())),
        ("Top services", ("Service", "Events"), [(r["service"], r["count"]) for r in report["top_services"]]),
        ("Top error signatures", ("Signature", "Events"), [(r["signature"][:60], r["total"]) for r in report["top_error_signatures"][:10]]),
        ("Alerts", ("Severity", "Title"), [(a["severity"], a["title"]) for a in report["alerts"]]),
    ]
    for title, head, rows in tables:
        lines += ["", f"## {title}", "", f"| {head[0]} | {head[1]} |", "|---|---|", *(f"| {cell(a)} | {cell(b)} |" for a, b in rows)]
    return "\n".join(lines) + "\n"
