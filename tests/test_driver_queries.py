import datetime as dt
import os

import duckdb
import pytest

from sparklog import driver_ingest, driver_queries

SF = os.environ.get("SPARKLOG_TEST_SF", "/root/testdata/sf0.001")


def plain(value):
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(driver_queries.queries()))
def test_matches_sql(spark, duck, name):
    df = driver_queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.sql(driver_queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert ours == sorted(repr([plain(r[k]) for k in order]) for r in found.fetchall())


def test_dedup_append_asks_the_store(spark, monkeypatch):
    asked = []
    new_events = driver_ingest.EventStore.new_events
    monkeypatch.setattr(driver_ingest.EventStore, "new_events", lambda self, events: asked.append(self.events().count()) or new_events(self, events))
    found = driver_ingest.dedup_append(spark, SF).count()
    n = driver_queries.events(spark, SF).count()
    assert asked == [0, n - found] and 0 < found < n
