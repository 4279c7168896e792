"""What shows on large tables only: joins that are not broadcast, results beyond the limits of interactive queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparklog import driver_queries, export
from sparklog.driver_events import events
from sparklog.operators.query import QueryError, frame
from sparklog.operators.store import EventStore
from sparklog.schema import ROW_COLUMNS

SF = "/root/testdata/sf0.001"


def sorted_rows(rows, columns, names):
    return sorted(repr([r[names.index(c)] for c in columns]) for r in rows)


def matches(spark, name, folder):
    df = driver_queries.queries()[name](spark, folder)
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{folder}/events.parquet'")
    want = duck.sql(driver_queries.oracle_sql()[name])
    columns = sorted(df.columns)
    return sorted_rows(df.collect(), columns, df.columns) == sorted_rows(want.fetchall(), columns, want.columns)


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_insert_of_known_events_counts_none(spark, tmp_path, no_broadcast):
    own, store = events(spark, SF), EventStore(spark, str(tmp_path / "store"))
    n = own.count()
    assert [store.insert(x) for x in (own, own, own.limit(0))] == [n, 0, 0]
    assert store.events().count() == n


@pytest.mark.parametrize("name", ["insert_counts", "source_table", "ingest_files", "ingest_then_tail"])
def test_queries_that_insert_again(spark, no_broadcast, name):
    assert matches(spark, name, SF)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A folder of 300,000 events, 60,000 errors of which."""
    folder = tmp_path_factory.mktemp("large")
    duckdb.connect().sql(f"copy (select e.* replace (event_id + 1000 * k as event_id) from '{SF}/events.parquet' e, range(300) r(k)) to '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["export_csv", "export_jsonl", "export_parquet", "literal_types"])
def test_queries_beyond_interactive_limits(spark, large, name):
    assert matches(spark, name, large)


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "parquet"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_export_has_every_row_and_value(spark, large, tmp_path, fmt, kind):
    own = events(spark, large).withColumns({c: F.col(c).cast(kind) for c in ("timestamp", "ingested_at")})
    want = own.filter("severity = 'ERROR'").select(*ROW_COLUMNS)
    export.export_query(own, "", str(tmp_path / fmt), fmt)
    got = spark.read.schema(want.schema).options(**{"header": True, "escape": '"'} if fmt == "csv" else {}).format(fmt.replace("jsonl", "json")).load(str(tmp_path / fmt))
    assert got.count() == want.count() == 60_300
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_export_takes_the_limit_that_a_query_names(spark, large, tmp_path):
    export.export_query(events(spark, large), "| limit 110000", str(tmp_path / "some"), "parquet")
    assert spark.read.parquet(str(tmp_path / "some")).count() == 110_000
    assert frame(events(spark, large), "").count() == 1000
    with pytest.raises(QueryError):
        export.export_query(events(spark, large), "| limit 5000000000", str(tmp_path / "none"), "parquet")
