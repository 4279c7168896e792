"""Command line: version, inspect, query, validate-query, generate-demo, workspace-info, report, launch.

Exit codes: 0 fine, 1 failed or an invalid query, 2 wrong usage, path or workspace, 3 a query that cannot run.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from contextlib import contextmanager
from itertools import islice

from sparklog.operators.query import QueryError, execute, validate

VERSION = "0.1.0"


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sparklog").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _show(args: argparse.Namespace, data: dict, text: str) -> None:
    print(json.dumps(data, default=str, ensure_ascii=False) if args.json else text)


@contextmanager
def _ingested(args: argparse.Namespace, paths: str | list[str]):
    """A store with the files' events, which is deleted afterwards, and the result of ingestion."""
    from sparklog.folders import work_folder
    from sparklog.operators.store import EventStore
    from sparklog.sources.ingest import ingest

    spark = session()
    store = EventStore(spark, work_folder(spark))
    try:
        yield store, ingest(spark, store, paths, parser=args.parser, regex=args.regex, field_map=dict(x.split("=", 1) for x in args.field))
    finally:
        store.drop(store.path)


def cmd_version(args: argparse.Namespace) -> int:
    _show(args, {"version": VERSION}, VERSION)
    return 0


def cmd_inspect(args: argparse.Namespace) -> int:
    """The files with their formats, and severities and first events of the first file."""
    from pyspark.sql import functions as F

    from sparklog.operators.analytics import severity_distribution
    from sparklog.sources.ingest import inspect

    files = list(inspect(session(), args.path, args.parser))
    shown = [{"path": f.path, "size": f.size, "mtime_ns": f.modified_ns, "format": f.detection.format, "score": f.detection.score, "kind": f.content_kind} for f in islice(files, 20)]
    data = {"file_count": len(files), "files": shown}
    lines = [f"{len(files)} file(s), 20 shown at most"] + [f"{r['path']}\t{r['size']} bytes\t{r['format']} ({r['score']:.2f})\t{r['kind']}" for r in shown]
    if files:
        with _ingested(args, files[0].path) as (store, result):
            first = store.events().orderBy(F.col("timestamp").asc_nulls_last(), "line_number").limit(args.limit)
            sample = [r.asDict() for r in first.select(F.col("timestamp").cast("string").alias("timestamp"), "severity", "service", "message").collect()]
            severities = {r["severity"]: r["count"] for r in severity_distribution(store.events()).collect()}
            data |= {"first_file": files[0].path, "parser": files[0].detection.format, "events": result.total, "severity": severities, "sample": sample}
        lines += ["", f"{files[0].path}: {result.total} events", *(f"{k}\t{n}" for k, n in severities.items()), "", *("\t".join(str(v or "-") for v in r.values()) for r in sample)]
    _show(args, data, "\n".join(lines))
    return 0


def cmd_query(args: argparse.Namespace) -> int:
    ok, message = validate(args.query)
    if not ok:
        print(message, file=sys.stderr)
        return 3
    with _ingested(args, args.path) as (store, _):
        try:
            found = execute(store.events(), args.query, base_limit=args.limit)
        except QueryError as e:
            print(e, file=sys.stderr)
            return 3
    table = "\n".join("\t".join("" if v is None else str(v) for v in row) for row in [found.columns, *found.rows])
    _show(args, {"columns": found.columns, "rows": found.rows, "row_count": found.row_count, "elapsed_ms": found.elapsed_ms, "is_aggregation": found.is_aggregation}, table)
    return 0


def cmd_validate(args: argparse.Namespace) -> int:
    ok, message = validate(args.query)
    _show(args, {"ok": ok, "message": message}, message)
    return 0 if ok else 1


def cmd_demo(args: argparse.Namespace) -> int:
    from sparklog.demo import write_demo

    write_demo(session(), args.folder, args.events, seed=args.seed, minutes=args.minutes, incidents=not args.no_incident)
    _show(args, {"folder": args.folder, "events": args.events}, f"wrote {args.events} events to {args.folder}")
    return 0


def cmd_workspace(args: argparse.Namespace) -> int:
    from dataclasses import asdict

    from sparklog.workspace import load_workspace

    try:
        w = asdict(load_workspace(args.path))
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    lines = [f"{w['name']} (version {w['version']}, {w['workspace_id']})", f"created {w['created_at']}, changed {w['updated_at']}"]
    lines += [f"source\t{s['alias'] or s['path']}" for s in w["sources"]] + [f"query\t{q['name']}\t{q['query']}" for q in w["saved_queries"]] + [f"rule\t{r['name']}\t{'on' if r['enabled'] else 'off'}" for r in w["rules"]]
    _show(args, w, "\n".join(lines))
    return 0


def cmd_report(args: argparse.Namespace) -> int:
    from sparklog.export import report_json, report_markdown, session_report

    with _ingested(args, args.path) as (store, _):
        report = session_report(store.events())
    print(report_json(report) if args.json else report_markdown(report))
    return 0


def cmd_launch(args: argparse.Namespace) -> int:
    print("sparklog has no desktop window; use query, report or the library", file=sys.stderr)
    return 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparklog", description=__doc__)
    top.add_argument("--json", action="store_true", help="print JSON")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)
        sub.set_defaults(run=run)

    reading = (("--parser", {}), ("--regex", {}), ("--field", {"action": "append", "default": [], "metavar": "COLUMN=GROUP", "help": "a group of --regex, with --parser custom_regex"}))
    add("version", cmd_version)
    add("inspect", cmd_inspect, ("path", {}), ("--limit", {"type": int, "default": 20}), *reading)
    add("query", cmd_query, ("path", {}), ("query", {}), ("--limit", {"type": int, "default": 1000}), *reading)
    add("validate-query", cmd_validate, ("query", {}))
    add("generate-demo", cmd_demo, ("folder", {"nargs": "?", "default": "./demo-logs"}), ("--events", {"type": int, "default": 50_000}), ("--seed", {"type": int, "default": 42}), ("--minutes", {"type": int, "default": 240}), ("--no-incident", {"action": "store_true"}))
    add("workspace-info", cmd_workspace, ("path", {}))
    add("report", cmd_report, ("path", {}), *reading)
    add("launch", cmd_launch)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if getattr(args, "path", None) and not os.path.exists(args.path):
        print(f"not found: {args.path}", file=sys.stderr)
        return 2
    try:
        return args.run(args)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
