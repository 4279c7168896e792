"""A streaming source of appended lines, and the stream that parses, deduplicates, stores and evaluates them.

The source's offset is JSON: for each file its position, format, inode, and length and hash of its head. A file that
shrinks, or whose head no longer has the hash, starts again at 0; one whose inode changes or that vanishes stops.
Positions are in Spark's checkpoint, so a restarted stream goes on where it was.

A batch ends at a line break, so partial lines wait. In formats whose lines fold (stack traces), it ends before the last
primary line, so the open event waits too, until the next primary line or until the file has been still for `flushAfter`
seconds; what comes later than that is an event of its own, and so is the rest of an event above LOOK bytes. To find
these ends the driver reads the last LOOK bytes at most of what is new, and HEAD bytes of each file. All else is read in
tasks: new bytes are cut into slices of SLICE bytes, each a partition, whose lines count in the partition. A batch takes
`maxBytesPerTrigger` of a file at most (all of it where that holds a line or event that is longer).
"""

from __future__ import annotations

import fnmatch
import glob
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from sparklog.functions import moment
from sparklog.operators.rules import RuleConfig, run_all
from sparklog.operators.store import EventStore, source_id
from sparklog.schema import EVENT_COLUMNS, EVENT_SCHEMA
from sparklog.sources import parsers
from sparklog.sources.detect import detect, header_of, sample_lines
from sparklog.sources.formats import Source
from sparklog.sources.lines import CUT, MAX_LINE, PRIMARY_LINE, fold, resolved

HEAD, SAMPLE = 4096, 64 * 1024
BLOCK, LOOK, SLICE = 1 << 20, 1 << 20, 64 << 20


class Files:
    """Files by path, local or of a store that pyarrow opens (hdfs, s3, gs: a URI)."""

    @staticmethod
    def _split(path: str) -> tuple[Any, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    @staticmethod
    def stat(path: str) -> tuple[int, int | None, float]:
        """Size, inode (local files only), time of the last change."""
        if "://" not in path:
            found = os.stat(path)
            return found.st_size, found.st_ino, found.st_mtime
        system, inner = Files._split(path)
        info = system.get_file_info(inner)
        if not info.is_file:
            raise FileNotFoundError(path)
        return info.size, None, (info.mtime_ns or 0) / 1e9

    @staticmethod
    def read(path: str, start: int, size: int) -> bytes:
        system, inner = Files._split(path)
        with system.open_input_file(inner) as f:
            f.seek(min(start, f.size()))
            return f.read(size)

    @staticmethod
    def matching(pattern: str) -> list[str]:
        """Files that a path, folder or pattern names."""
        if "://" not in pattern:
            literal = glob.escape(pattern)
            every = glob.glob(f"{literal}/**", recursive=True) if os.path.isdir(pattern) else glob.glob(literal if os.path.exists(pattern) else pattern, recursive=True)
            return sorted(p for p in every if os.path.isfile(p))
        from pyarrow import fs

        system, inner = Files._split(pattern)
        prefix = pattern[: len(pattern) - len(inner)]
        base = inner if not glob.has_magic(inner) else inner[: min(inner.index(c) for c in "*?[" if c in inner)].rsplit("/", 1)[0]
        info = system.get_file_info(base)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        names = [f.path for f in found if f.is_file]
        return sorted(prefix + n for n in names if not glob.has_magic(inner) or fnmatch.fnmatch(n, inner))


def _hash(path: str, size: int) -> str:
    return hashlib.sha256(Files.read(path, 0, size)).hexdigest()


def _last_break(path: str, start: int, end: int) -> int:
    """The position after the last line break in [start, end), or start."""
    while end > start:
        low = max(start, end - BLOCK)
        found = Files.read(path, low, end - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        end = low
    return start


def _open_event(path: str, start: int, end: int) -> int:
    """Where the last primary line of [start, end) begins; start if no line is, end if none of the last LOOK bytes is."""
    low = max(start, end - LOOK)
    at, opened = low, None
    for k, line in enumerate(Files.read(path, low, end - low).split(b"\n")[:-1]):
        if (k or low == start) and PRIMARY_LINE.match(line.removesuffix(b"\r").decode(errors="replace")):
            opened = at
        at += len(line) + 1
    return opened if opened is not None else start if low == start else end


def _end(path: str, start: int, size: int, most: int | None, folds: bool, still: bool) -> int:
    """Where the next batch of a file ends."""
    limit = min(size, start + most) if most else size
    end = _last_break(path, start, limit)
    if folds and end > start and not (still and limit == size):
        end = _open_event(path, start, end)
    return end if end > start or limit == size else _end(path, start, size, None, folds, still)


def _header(path: str) -> str:
    """Cells of a CSV file's header, and where the lines after it begin, as JSON."""
    at = 0
    for line in Files.read(path, 0, SAMPLE).split(b"\n"):
        at += len(line) + 1
        if cells := header_of(sample_lines(line)):
            return json.dumps({"cells": cells, "body": at})
    return json.dumps({"cells": [], "body": 0})


def advanced(path: str, state: dict | None, first: int | str = 0, *, parser: str | None = None, most: int | None = None, flush_after: float = 0.0, now: float | None = None) -> dict:
    """A file's state after what it holds now; `from` is where reading of its present content began. most holds for known files."""
    most = most if state else None
    try:
        size, inode, changed = Files.stat(path)
    except FileNotFoundError:
        return (state or {"at": 0, "from": 0}) | {"dead": "missing"}
    if state is None:
        at = _last_break(path, 0, size) if first == "latest" else 0 if first == "earliest" else min(int(first), size)
        state = {"at": at, "from": at, "inode": inode, "head": 0, "hash": _hash(path, 0)}
    if state.get("dead"):
        return state
    if inode != state["inode"]:
        return state | {"dead": "rotated"}
    if size < state["at"] or _hash(path, state["head"]) != state["hash"]:
        state = {"at": 0, "from": 0, "inode": inode, "head": 0, "hash": _hash(path, 0)}
    if "kind" not in state:
        lines = sample_lines(Files.read(path, 0, SAMPLE))
        if not lines or (len(lines) == 1 and _last_break(path, 0, min(size, SAMPLE)) == 0):
            return state  # no whole line to judge the format by
        kind = detect(lines, parser, path).format
        state = state | {"kind": kind, "header": _header(path) if kind == "csv" else "{}"}
    still = (time.time() if now is None else now) - changed >= flush_after
    end = _end(path, state["at"], size, most, parsers.parser_of(state["kind"]).folds, still)
    head = min(HEAD, end)
    return state | {"at": end, "head": head, "hash": _hash(path, head)}


@dataclass
class Slice(InputPartition):
    path: str
    first: int  # where the file's new bytes begin
    start: int
    end: int
    last: int  # where they end, after a line break
    kind: str
    header: str


COLUMNS = "source_path string, split long, byte_offset long, line_number long, head long, text string, kind string, header string"


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern, self.first, self.parser = options["path"], options.get("startingoffset", "earliest"), options.get("parser") or None
        self.most = int(options["maxbytespertrigger"]) if options.get("maxbytespertrigger") else None
        self.flush_after, self.slice = float(options.get("flushafter", 0)), int(options.get("slicebytes", SLICE))
        self.states, self.batch = {}, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}", "batch": "0"}

    def latestOffset(self) -> dict:  # noqa: N802
        known = self.states
        paths = dict.fromkeys([*known, *Files.matching(self.pattern)])
        states = {p: advanced(p, known.get(p), self.first, parser=self.parser, most=self.most, flush_after=self.flush_after) for p in paths}
        if states != known:
            self.states, self.batch = states, self.batch + 1
        return {"files": json.dumps(self.states, sort_keys=True), "batch": str(self.batch)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.states, self.batch = after, int(end["batch"])
        out = []
        for path, state in after.items():
            old = before.get(path)
            if state.get("dead") or "kind" not in state:
                continue
            if old is None:
                begin = state["from"]
            else:  # also after a restart, when this reader has not seen the file shrink or change
                begin = old["at"] if old["at"] <= state["at"] and _hash(path, old["head"]) == old["hash"] else 0
            for low in range(begin, state["at"], self.slice):
                out.append(Slice(path, begin, low, min(low + self.slice, state["at"]), state["at"], state["kind"], state["header"]))
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the slice, with the last primary line of the slice up to each (null: none)."""
        p = partition
        folds, opened, number, at = parsers.parser_of(p.kind).folds, None, 0, p.start
        # A line that begins in an earlier slice is read there, to its end.
        data = Files.read(p.path, p.start, p.end - p.start) if p.start == p.first else Files.read(p.path, p.start - 1, p.end - p.start + 1)
        if p.start != p.first:
            skip = data.find(b"\n") + 1
            if not skip:
                return
            at, data = p.start - 1 + skip, data[skip:]
        end = p.end
        if not data:
            return
        while not data.endswith(b"\n") and end < p.last:
            more = Files.read(p.path, end, min(BLOCK, p.last - end))
            cut = more.find(b"\n") + 1
            data, end = data + (more[:cut] if cut else more), end + len(more)
            if not more or cut:
                break
        texts, offsets, numbers, heads, held = [], [], [], [], 0
        for piece in data.split(b"\n")[: -1 if data.endswith(b"\n") else None]:
            text = piece.removesuffix(b"\r").decode(errors="replace")
            text = text if len(text) <= MAX_LINE else text[:MAX_LINE] + CUT
            if folds and PRIMARY_LINE.match(text):
                opened = at
            number += 1
            texts.append(text), offsets.append(at), numbers.append(number), heads.append(opened)
            at, held = at + len(piece) + 1, held + len(piece)
            if len(texts) == 10_000 or held > BLOCK * 8:
                yield self._batch(p, texts, offsets, numbers, heads)
                texts, offsets, numbers, heads, held = [], [], [], [], 0
        if texts:
            yield self._batch(p, texts, offsets, numbers, heads)

    @staticmethod
    def _batch(p: Slice, texts: list[str], offsets: list[int], numbers: list[int], heads: list[int | None]) -> pa.RecordBatch:
        n = len(texts)
        long, text = pa.int64(), pa.string()
        columns = [pa.array([p.path] * n, text), pa.array([p.start] * n, long), pa.array(offsets, long), pa.array(numbers, long), pa.array(heads, long), pa.array(texts, text), pa.array([p.kind] * n, text), pa.array([p.header] * n, text)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """format("logtail"): options path (file, folder or pattern), startingOffset (earliest, latest or bytes), parser, flushAfter (seconds), maxBytesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader({k.lower(): v for k, v in self.options.items()})


def read_tail(spark: SparkSession, path: str, starting_offset: str | int = "earliest", **options: str) -> DataFrame:
    """A streaming DataFrame of lines appended to the files. line_number counts in the slice (`split`) that a task reads."""
    spark.dataSource.register(LogTail)
    stream = spark.readStream.format("logtail").option("path", resolved(spark, path)).option("startingOffset", str(starting_offset))
    return stream.options(**{k: v for k, v in options.items() if v}).load()


class LineCounts:
    """Lines of each file up to its position, by batch, in a folder beside the checkpoint; a batch that is run again starts from the one before it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _file(self, batch: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{batch}.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def load(self, batch: int) -> dict[str, int]:
        system, path = self._file(batch)
        if not system.exists(path):
            return {}
        stream = system.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def save(self, batch: int, counts: dict[str, int]) -> None:
        system, path = self._file(batch)
        stream = system.create(path, True)
        try:
            stream.write(bytearray(json.dumps(counts).encode()))
        finally:
            stream.close()
        old, path = self._file(batch - 2)
        with suppress(Exception):
            old.delete(path, False)


def _numbered(lines: DataFrame, counts: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """lines with numbers in their files and the primary line of each (`event`), and the counts after them."""
    slices = lines.groupBy("source_path", "split").agg(F.max("line_number").alias("n"), F.max("head").alias("head")).collect()  # a row a slice of a batch
    after, places, heads = dict(counts), [], {}
    for r in sorted(slices, key=lambda r: (r["source_path"], r["split"])):
        path = r["source_path"]
        before = after.get(path, 0) if r["split"] else 0
        places.append((path, r["split"], before, heads.get(path)))
        heads[path] = r["head"] if r["head"] is not None else heads.get(path)
        after[path] = before + r["n"]
    held = lines.sparkSession.createDataFrame(places, "source_path string, split long, lines_before long, carried long")
    event = F.coalesce("head", "carried", F.lit(-1).cast("long"))
    joined = lines.join(held, ["source_path", "split"])
    return joined.withColumns({"line_number": F.col("line_number") + F.col("lines_before"), "event": event}), after


def parse_batch(lines: DataFrame, kinds: list[tuple[str, str]], source: Source) -> DataFrame:
    """Events of numbered lines; kinds: formats and CSV headers (as JSON) among them."""
    parts = []
    for kind, header in kinds:
        own = lines.filter((F.col("kind") == kind) & (F.col("header") == header))
        format_ = parsers.parser_of(kind)
        if format_.folds:
            parts.append(format_.parse(fold(own), (), source))
        else:
            given = json.loads(header)
            body = own.filter(F.col("byte_offset") >= given.get("body", 0)).select("source_path", "byte_offset", "line_number", "text")
            parts.append(format_.parse(body, tuple(given.get("cells", ())), source))
    return reduce(DataFrame.unionByName, parts)


def start_tail(
    spark: SparkSession, store: EventStore, path: str, checkpoint: str, *, parser: str | None = None, regex: str | None = None, field_map: dict[str, str] | None = None, rules: list[RuleConfig] | None = None,
    on_events: Callable[[DataFrame, int], None] | None = None, on_alerts: Callable[[list[dict]], None] | None = None, starting_offset: str | int = "earliest", interval: str | None = "500 milliseconds",
    flush_after: float = 5.0, max_bytes: int | None = 1 << 30,
) -> StreamingQuery:
    """Tail files into the store: each batch is parsed, new events are appended and given to on_events with their count,
    then the rules run. interval None: take what is there and stop (max_bytes does not hold then).

    A file's format is detected once and kept. Line numbers count from where reading of the file began. A file that was
    or will be ingested too has the same path, source id and event ids there.
    """
    counts = LineCounts(spark, f"{checkpoint}/line-counts")

    def batch(lines: DataFrame, number: int) -> None:
        lines = lines.persist()
        try:
            kinds = [tuple(r) for r in lines.select("kind", "header").distinct().collect()]  # a row a format and CSV header
            numbered, after = _numbered(lines, counts.load(number - 1))
            if kinds:
                source = Source(ingested_at=datetime.now(UTC), regex=regex, field_map=field_map or {})
                parsed = parse_batch(numbered, sorted(kinds), source).withColumn("source_id", source_id(F.col("source_path")))
                events = parsed.select(*EVENT_COLUMNS).persist()
                try:
                    inserted = store.insert(events)
                    if on_events and inserted:
                        own = [r[0] for r in events.select("source_id").distinct().collect()]  # a row a file
                        stamped = F.col("ingested_at") == moment(source.ingested_at, EVENT_SCHEMA["ingested_at"].dataType)
                        on_events(store.events().filter(F.col("source_id").isin(own) & stamped), inserted)
                finally:
                    events.unpersist()
                if rules and on_alerts:
                    on_alerts(run_all(store.events(), rules, known=store.known_signatures()).alerts)
            counts.save(number, after)
        finally:
            lines.unpersist()

    limit = str(max_bytes) if interval and max_bytes else ""
    lines = read_tail(spark, path, starting_offset, parser=parser or "", flushAfter=str(flush_after), maxBytesPerTrigger=limit)
    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
