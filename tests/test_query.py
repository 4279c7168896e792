import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparklog.operators.query import QueryError, execute, frame
from sparklog.schema import EVENT_SCHEMA, ROW_COLUMNS

AT = dt.datetime(2026, 9, 1, 12, tzinfo=dt.UTC)


def event(i, **over):
    base = dict.fromkeys(EVENT_SCHEMA.fieldNames()) | {
        "event_id": f"e{i}", "source_id": 1, "source_alias": "s", "source_path": "/p", "line_number": i, "byte_offset": i, "raw_format": "json", "timestamp": AT, "ingested_at": AT,
        "severity": "INFO", "message": f"msg {i}", "raw_text": f"msg {i}", "service": "payments",
    }
    return tuple((base | over).values())


@pytest.fixture(scope="module")
def events(spark):
    rows = [event(i, severity="ERROR" if i % 2 == 0 else "INFO", service="api" if i % 3 == 0 else "payments", trace_id="t1" if i <= 5 else "t2", request_id=f"r{i}", duration_ms=10.0 * i, status_code=200 if i % 2 == 0 else 500) for i in range(1, 11)]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def ids(events, text):
    return [r["event_id"] for r in frame(events, text).collect()]


def test_filters(events):
    assert len(ids(events, "level = ERROR")) == 5
    assert len(ids(events, "NOT level = ERROR")) == 5
    assert len(ids(events, 'service IN ("api","payments")')) == 10
    assert ids(events, "duration > 75 and trace_id = t2") == ["e8", "e9", "e10"]
    assert ids(events, 'message ENDS_WITH "_0"') == ["e10"]
    assert ids(events, "status = TRUE") == []
    assert ids(events, 'message CONTAINS "%"') == []


def test_backslash_is_literal(spark, events):
    own = spark.createDataFrame([event(1, message="a\\b")], EVENT_SCHEMA)
    assert ids(own, r'message STARTS_WITH "a\\"') == ["e1"]
    assert ids(own, r'message CONTAINS "\\b"') == ["e1"]


@pytest.mark.parametrize("text", ["'; DROP TABLE events; --", "1 OR 1=1", '") OR TRUE --'])
def test_values_are_never_code(events, text):
    quoted = text.replace('"', '\\"')
    assert ids(events, f'message = "{quoted}"') == []


def test_stats(events):
    found = execute(events, "| stats count() by service | sort count desc")
    assert (found.columns, found.rows, found.is_aggregation) == (["service", "count"], [("payments", 7), ("api", 3)], True)
    found = execute(events, "level = NOSUCH | stats count(), max(duration)")
    assert found.rows == [(0, None)]
    assert execute(events, "| limit 5 | stats count()").rows == [(10,)]
    assert execute(events, "| stats p50(duration), p95(duration)").rows == [(55.0, 95.5)]


def test_rows(events):
    found = execute(events, "| sort duration desc | limit 2")
    assert found.columns == list(ROW_COLUMNS)
    assert [r[0] for r in found.rows] == ["e10", "e9"]
    assert len(ids(events, "| limit 0")) == 1
    assert execute(events, "", base_limit=3).row_count == 3
    assert execute(events, "", base_limit=3).truncated
    assert not execute(events, "| limit 100").truncated


def test_nulls_last(spark):
    own = spark.createDataFrame([event(1, duration_ms=None), event(2, duration_ms=5.0), event(3, duration_ms=7.0, timestamp=None)], EVENT_SCHEMA)
    assert ids(own, "| sort duration desc") == ["e3", "e2", "e1"]
    assert ids(own, "| sort duration") == ["e2", "e3", "e1"]
    assert ids(own, "") == ["e1", "e2", "e3"]


def test_time_literals(events):
    assert len(ids(events, 'ts >= "2026-09-01T14:00:00+02:00"')) == 10
    assert ids(events, 'ts > "2026-09-01T12:00:00Z"') == []
    with pytest.raises(QueryError):
        execute(events, "ts > yesterday")


def test_plans_push_filters_and_prune_columns(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(path)
    stored = spark.read.parquet(path)
    plan = frame(stored, 'ts >= "2026-09-01" and level = ERROR | stats max(duration) by service')._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp), IsNotNull(severity)" in plan
    assert "PartitionFilters: [isnotnull(event_date" in plan
    scan = plan[plan.rindex("ReadSchema") :].split(">")[0]
    assert "message" not in scan
    top = frame(stored, "| sort duration desc | limit 3")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top
