"""The event store: Parquet partitioned by source and event date (UTC), appended without duplicates; and the source table.

Within source and date, files are sorted by time, so that row-group statistics prune. An insert keeps one row an
event_id and leaves out the ids that the store has. An id hashes its event's path and byte offset, so only stored events
of the batch's sources and inside its range of offsets can have it: an anti join on those, which for appended lines
reads next to nothing. Counts come from the rows that were written. Source statistics are an append-only table of
runs, summed when read; settings (enabled) are rows of it too. So are the known error signatures, a small table that
follows the files of events by their time of writing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparklog.functions import as_utc, utc_date
from sparklog.operators.analytics import error_signatures
from sparklog.schema import EVENT_COLUMNS, EVENT_SCHEMA

COUNTERS = ("total_events", "inserted_events", "unstructured_lines", "parse_errors", "rejected_lines")
SETTINGS = ("alias", "enabled", "parser", "size_bytes", "mtime_ns", "sample_hash", "content_kind", "last_byte_offset")
RUN_SCHEMA = (
    "run_id string, source_id long, path string, alias string, enabled boolean, parser string, size_bytes long, mtime_ns long, sample_hash string, content_kind string, ingested_at timestamp, "
    "total_events long, inserted_events long, unstructured_lines long, parse_errors long, rejected_lines long, last_byte_offset long, first_event_at timestamp, last_event_at timestamp, deleted boolean"
)
SIGNATURE_SCHEMA = "signature string, first_seen timestamp, covered timestamp"
#: Files of a writer with a slower clock are seen again this long.
OVERLAP = 600_000_000  # microseconds
#: Sources of a batch that are named in the scan of the store; more are found by a join.
NAMED_SOURCES = 1000


def source_id(path: Column) -> Column:
    """The id of a source path: a hash, so that ids need no counter and never clash between writers."""
    return F.xxhash64(path).bitwiseAND(F.lit((1 << 63) - 1))


class EventStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        """All events, with event_date (the partition) for pruning."""
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA)
        return self._read("events", f"{fields}, event_date date")

    def staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """rows written below the store and read again, and the folder, which drop() deletes."""
        folder = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder), folder

    def drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def new_events(self, events: DataFrame) -> DataFrame:
        """events without repeated ids and without those that the store has. events is read twice: best a written or cached one."""
        ranges = events.groupBy("source_id").agg(F.min("byte_offset").alias("low"), F.max("byte_offset").alias("high"))
        sources = ranges.limit(NAMED_SOURCES + 1).collect()
        stored = self.events().select("event_id", "source_id", "byte_offset")
        if len(sources) <= NAMED_SOURCES:
            low, high = ([r[k] for r in sources if r[k] is not None] for k in ("low", "high"))
            inside = F.col("byte_offset").between(min(low), max(high)) if low else F.lit(False)
            stored = stored.filter(F.col("source_id").isin([r["source_id"] for r in sources]) & (inside | F.col("byte_offset").isNull()))
        else:
            stored = stored.join(ranges.select("source_id"), "source_id", "left_semi")
        return events.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti")

    def insert(self, events: DataFrame) -> int:
        """Append the new events and return how many there were. Times without a zone are UTC."""
        rows = self.new_events(events)
        rows = rows.select(*[as_utc(F.col(c), events.schema[c].dataType).alias(c) for c in EVENT_COLUMNS])
        counter = Observation(f"insert-{uuid.uuid4().hex}")
        self._append(rows.withColumn("event_date", utc_date(F.col("timestamp"))), "append", counter)
        return int(counter.get["n"])

    def _append(self, rows: DataFrame, mode: str, counter: Observation | None = None) -> None:
        """Write events with their date; adaptive execution makes a task of every advisory size of a source and day.

        The counter stands after the shuffle: below it, adaptive execution drops it with the rest of the plan where no row is left.
        """
        dealt = rows.hint("rebalance", F.col("source_id"), F.col("event_date"))
        if counter is not None:
            dealt = dealt.observe(counter, F.count(F.lit(1)).alias("n"))
        dealt = dealt.sortWithinPartitions("source_id", "event_date", "timestamp")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "event_date").parquet(f"{self.path}/events")

    def compact(self, files: int = 8) -> int:
        """Rewrite the partitions of more than `files` files, and return how many there were. Not to run beside writers."""
        places = self.events().select("source_id", "event_date", F.col("_metadata.file_path").alias("file"))
        crowded = places.distinct().groupBy("source_id", "event_date").count().filter(F.col("count") > files).drop("count")
        crowded, listed = self.staged(crowded)
        found = crowded.count()
        if found:
            own, c = self.events().alias("e"), crowded.alias("c")
            same = (F.col("e.source_id") == F.col("c.source_id")) & F.col("e.event_date").eqNullSafe(F.col("c.event_date"))
            rows, held = self.staged(own.join(c, same, "left_semi"))
            self._append(rows, "overwrite")
            self.drop(held)
        self.drop(listed)
        return found

    def record_runs(self, runs: Iterable[dict[str, Any]]) -> None:
        """Append rows to the table of runs: one write for all of them."""
        names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
        common = {"run_id": uuid.uuid4().hex, "ingested_at": datetime.now(UTC), "deleted": False} | dict.fromkeys(COUNTERS, 0)
        rows = [tuple((common | run).get(n) for n in names) for run in runs]
        if rows:
            frame = self.spark.createDataFrame(rows, RUN_SCHEMA).withColumn("source_id", source_id(F.col("path")))
            frame.coalesce(1 + len(rows) // 100_000).write.mode("append").parquet(f"{self.path}/runs")

    def record_run(self, **run: Any) -> None:
        self.record_runs([run])

    def known_signatures(self) -> DataFrame:
        """signature and first_seen of all stored errors; reads only files written since the last call, and adds theirs."""
        held = self._read("signatures", SIGNATURE_SCHEMA)
        if self._has("events"):
            covered = held.agg(F.max(F.unix_micros("covered"))).first()[0]
            written = F.col("_metadata.file_modification_time")
            fresh = self.events() if covered is None else self.events().filter(written > F.timestamp_micros(F.lit(covered - OVERLAP)))
            latest = fresh.agg(F.max(F.unix_micros(written))).first()[0]
            if latest is not None and latest != covered:
                until = F.timestamp_micros(F.lit(latest))
                found = error_signatures(fresh.filter(F.col("timestamp").isNotNull())).select("signature", "first_seen", until.alias("covered"))
                mark = self.spark.range(1).select(F.lit("").alias("signature"), F.lit(None).cast("timestamp").alias("first_seen"), until.alias("covered"))
                found.unionByName(mark).coalesce(1).write.mode("append").parquet(f"{self.path}/signatures")
                held = self._read("signatures", SIGNATURE_SCHEMA)
        return held.filter("first_seen is not null").groupBy("signature").agg(F.min("first_seen").alias("first_seen"))

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path))

    def has_runs(self) -> bool:
        return self._has("runs")

    def sources(self) -> DataFrame:
        """A row a source: counters summed over runs since it was last deleted, latest settings, first and last event."""
        runs = self._read("runs", RUN_SCHEMA)
        gone = runs.filter("deleted").groupBy("path").agg(F.max("ingested_at").alias("gone"))
        live = runs.filter("not deleted").join(gone, "path", "left").filter("gone is null or ingested_at > gone")
        latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ingested_at"))).alias(c) for c in ("source_id", *SETTINGS)]
        sums = [F.sum(c).alias(c) for c in COUNTERS]
        run = F.when(F.col("parser").isNotNull(), F.col("ingested_at"))
        found = live.groupBy("path").agg(*latest, *sums, F.min("first_event_at").alias("first_event_at"), F.max("last_event_at").alias("last_event_at"), F.max(run).alias("last_ingested_at"))
        return found.withColumn("enabled", F.coalesce("enabled", F.lit(True)))

    def list_sources(self) -> DataFrame:
        return self.sources().orderBy("alias", "path")

    def get_source(self, path: str) -> DataFrame:
        return self.sources().filter(F.col("path") == path)

    def set_enabled(self, path: str, enabled: bool) -> None:
        self.record_run(path=path, enabled=enabled)

    def progress(self, path: str, **values: Any) -> None:
        """Add to a source's counters (COUNTERS) and set what else is given (SETTINGS, first_event_at, last_event_at)."""
        unknown = set(values) - {*COUNTERS, *SETTINGS, "first_event_at", "last_event_at"}
        if unknown:
            raise ValueError(f"unknown source fields: {', '.join(sorted(unknown))}")
        self.record_run(path=path, **values)

    def source_id(self, path: str) -> int:
        return int(self.spark.range(1).select(source_id(F.lit(path))).first()[0])

    def delete_source(self, path: str) -> None:
        """Drop a source's partitions and mark its runs deleted."""
        self.drop(f"{self.path}/events/source_id={self.source_id(path)}")
        self.drop(f"{self.path}/signatures")  # other sources' are found anew
        self.record_run(path=path, deleted=True)
