import os

import pytest

from sparklog.operators.store import EventStore
from sparklog.sources.ingest import ingest
from sparklog.streaming import tail
from sparklog.streaming.tail import Slice, TailReader, advanced, start_tail


def drain(spark, store, path, checkpoint, **options):
    start_tail(spark, store, str(path), str(checkpoint), interval=None, **options).awaitTermination(120)


def found(store):
    return sorted((r["byte_offset"], r["line_number"], r["message"]) for r in store.events().collect())


def test_appends_partial_lines_and_restarts(spark, tmp_path):
    log, store = tmp_path / "a.jsonl", EventStore(spark, str(tmp_path / "store"))
    log.write_text('{"message": "one"}\n{"mess')
    drain(spark, store, log, tmp_path / "check")
    assert found(store) == [(0, 1, "one")]
    with log.open("a") as f:
        f.write('age": "two"}\n{"message": "three"}\n')
    seen = []
    drain(spark, store, log, tmp_path / "check", on_events=lambda df, n: seen.append((n, sorted(r["message"] for r in df.collect()))))
    assert found(store) == [(0, 1, "one"), (19, 2, "two"), (38, 3, "three")]
    assert seen == [(2, ["three", "two"])]
    drain(spark, store, log, tmp_path / "check")
    assert len(found(store)) == 3


def test_truncated_file_starts_again(spark, tmp_path):
    log, store = tmp_path / "a.jsonl", EventStore(spark, str(tmp_path / "store"))
    log.write_text('{"message": "long enough line"}\n')
    drain(spark, store, log, tmp_path / "check")
    log.write_text('{"message": "new"}\n')
    drain(spark, store, log, tmp_path / "check")
    assert {(n, m) for _, n, m in found(store)} == {(1, "long enough line"), (1, "new")}


def test_an_event_that_comes_in_two_batches_is_one(spark, tmp_path):
    log, store = tmp_path / "a.log", EventStore(spark, str(tmp_path / "store"))
    log.write_text("2026-09-01 10:00:00 INFO first\n2026-09-01 10:00:01 ERROR boom\n")
    drain(spark, store, log, tmp_path / "check", flush_after=3600)
    assert [m for _, _, m in found(store)] == ["first"]
    with log.open("a") as f:
        f.write("Traceback:\n  File x\n2026-09-01 10:00:02 INFO last\n")
    drain(spark, store, log, tmp_path / "check", flush_after=3600)
    assert [(n, m) for _, n, m in found(store)] == [(1, "first"), (2, "boom\nTraceback:\n  File x")]
    drain(spark, store, log, tmp_path / "check", flush_after=0)
    assert [(n, m) for _, n, m in found(store)] == [(1, "first"), (2, "boom\nTraceback:\n  File x"), (5, "last")]
    batch = EventStore(spark, str(tmp_path / "batch"))
    ingest(spark, batch, str(log))
    key = lambda s: sorted((r["event_id"], r["line_number"], r["source_id"], r["source_path"]) for r in s.events().collect())
    assert key(batch) == key(store)


@pytest.mark.parametrize("name", ["a b+c%20[1].jsonl", "plain.log"])
def test_ingest_then_tail_stores_an_event_once(spark, tmp_path, name):
    folder = tmp_path / "real"
    folder.mkdir()
    (tmp_path / "link").symlink_to(folder)
    log, store = folder / name, EventStore(spark, str(tmp_path / "store"))
    log.write_text('{"message": "one"}\n{"message": "two"}\n' if name.endswith("jsonl") else "2026-09-01 10:00:00 INFO a\n2026-09-01 10:00:01 INFO b\n")
    assert ingest(spark, store, str(tmp_path / "link")).inserted == 2
    drain(spark, store, folder, tmp_path / "check", flush_after=0)
    assert store.events().count() == 2
    assert ingest(spark, store, str(folder)).inserted == 0
    assert store.sources().count() == 1
    assert {r["source_path"] for r in store.events().collect()} == {str(log)}


def test_quoted_csv_header_and_late_start(spark, tmp_path):
    log, store = tmp_path / "a.csv", EventStore(spark, str(tmp_path / "store"))
    log.write_text('\n"level","message","a,b"\nERROR,one,1\n')
    drain(spark, store, log, tmp_path / "check", parser="csv")
    with log.open("a") as f:
        f.write("WARN,two,2\n")
    drain(spark, store, log, tmp_path / "check", parser="csv")
    rows = store.events().orderBy("line_number").collect()
    assert [(r["line_number"], r["severity"], r["message"], r["attributes_json"]) for r in rows] == [(3, "ERROR", "one", '{"a,b":"1"}'), (4, "WARN", "two", '{"a,b":"2"}')]
    late = EventStore(spark, str(tmp_path / "late"))
    drain(spark, late, log, tmp_path / "check2", parser="csv", starting_offset=log.read_text().index("WARN"))
    assert [m for _, _, m in found(late)] == ["two"]


def test_states(tmp_path):
    log = tmp_path / "f"
    log.write_text("a\nb\nc\n")
    state = advanced(str(log), None, 4)
    assert (state["from"], state["at"]) == (4, 6)
    assert advanced(str(log), None, "latest")["from"] == 6
    state = advanced(str(log), None)
    log.write_text("other text\n")
    again = advanced(str(log), state)
    assert (again["from"], again["at"]) == (0, 11)
    os.rename(log, tmp_path / "old")
    assert advanced(str(log), again)["dead"] == "missing"
    keep = open(tmp_path / "hold", "w")
    log.write_text("x\n")
    assert advanced(str(log), again)["dead"] == "rotated"
    keep.close()


def test_ends_of_batches(tmp_path, monkeypatch):
    log = tmp_path / "f.log"
    one, two = "2026-09-01 10:00:00 INFO a\nmore\n", "2026-09-01 10:00:01 INFO b\nmore\n"
    log.write_text(one)
    held = advanced(str(log), None, flush_after=60)
    assert held["at"] == 0
    log.write_text(one + two + "part")
    assert advanced(str(log), held, flush_after=60)["at"] == len(one)
    assert advanced(str(log), held, flush_after=0)["at"] == len(one + two)
    assert advanced(str(log), held, flush_after=60, most=40)["at"] == len(one)
    assert advanced(str(log), held, flush_after=60, most=3)["at"] == len(one)  # no event is that short
    monkeypatch.setattr(tail, "LOOK", 8)
    assert advanced(str(log), held, flush_after=60)["at"] == len(one + two)
    for uri in (f"file://{log}",):
        assert advanced(uri, None)["at"] == len(one + two)
        assert tail.Files.matching(f"file://{tmp_path}/*.log") == [uri] == tail.Files.matching(f"file://{tmp_path}")


@pytest.mark.parametrize("size", [1, 3, 7, 30, 1000])
def test_slices_have_every_line_once(tmp_path, size):
    data = "stray\n2026-09-01 10:00:00 INFO é\r\n\nmore\n" * 5 + "\n\nlast\n"
    log = tmp_path / "f.log"
    log.write_bytes(data.encode())
    reader = TailReader({"path": str(log), "slicebytes": str(size)})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert all(isinstance(p, Slice) for p in parts)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    want, at = [], 0
    for piece in data.encode().split(b"\n")[:-1]:
        want.append((at, piece.decode().removesuffix("\r")))
        at += len(piece) + 1
    assert [(r["byte_offset"], r["text"]) for r in rows] == want
