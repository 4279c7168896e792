import importlib
import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sparklog.functions import bucket, event_id, signature, text_timestamp, utc_date, utc_text
from sparklog.operators.query import frame
from sparklog.operators.store import EventStore
from sparklog.sources import formats, parsers
from sparklog.sources.detect import SCORES, detect, fingerprints
from sparklog.sources.formats import Source
from sparklog.sources.ingest import ingest, inspect
from sparklog.sources.lines import read_folded, read_lines, slice_lines


def brute(data: bytes):
    out, at = [], 0
    for k, piece in enumerate(data.split(b"\n")):
        if piece or k < data.count(b"\n"):
            text = piece[:-1] if piece.endswith(b"\r") else piece
            out.append((at, k + 1, text.decode(errors="replace")))
        at += len(piece) + 1
    return out


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_offsets_hold_over_splits(spark, tmp_path, split):
    rnd = random.Random(5)
    data = {}
    for k in range(3):
        data[k] = b"".join(("é" * rnd.randint(0, 9) + "x" * rnd.randint(0, 30)).encode() + rnd.choice([b"\n", b"\r\n"]) for _ in range(150)) + b"last"
        (tmp_path / f"f{k}.log").write_bytes(data[k])
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for k, content in data.items():
        assert sorted((r["byte_offset"], r["line_number"], r["text"]) for r in rows if r["source_path"].endswith(f"f{k}.log")) == brute(content)


@pytest.mark.parametrize(("data", "want"), [(b"", []), (b"\n\n\n", [(0, 1, ""), (1, 2, ""), (2, 3, "")]), (b"a\r\nb", [(0, 1, "a"), (3, 2, "b")]), (b"\xff\n", [(0, 1, "�")])])
def test_small_files(spark, tmp_path, data, want):
    (tmp_path / "f").write_bytes(data)
    assert sorted(tuple(r)[1:] for r in read_lines(spark, str(tmp_path)).collect()) == want


def test_long_lines_are_cut(spark, tmp_path):
    (tmp_path / "f").write_text("y" * 5000 + "\nz\n")
    rows = read_lines(spark, str(tmp_path), max_line=100).orderBy("byte_offset").collect()
    assert rows[0]["text"] == "y" * 100 + "...[truncated]"
    assert rows[1]["byte_offset"] == 5001


def test_slices():
    assert slice_lines(b"a\r\nbb\n", 10, 4) == [(10, 4, "a"), (13, 5, "bb")]
    assert slice_lines(b"") == []


@pytest.mark.parametrize("split", ["40", "128m"])
def test_folding_over_splits(spark, tmp_path, split):
    lines = ["  stray", "more", "2026-09-01 10:00:00 ERROR boom", "Traceback:", '  File "x.py", line 1', "ValueError: no", "2026-09-01 10:00:01 INFO fine", "", "tail"]
    (tmp_path / "f.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = read_folded(spark, str(tmp_path)).orderBy("byte_offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in rows] == ["\n".join(lines[:2]), "\n".join(lines[2:6]), "\n".join(lines[6:])]
    assert [r["line_number"] for r in rows] == [1, 3, 7]
    assert rows[1]["byte_offset"] == len("  stray\nmore\n")
    parsed = formats.parse_text(read_folded(spark, str(tmp_path))).orderBy("byte_offset").collect()
    assert [(r["severity"], r["unstructured"]) for r in parsed] == [("UNKNOWN", True), ("ERROR", False), ("INFO", False)]


def lines_of(spark, *texts):
    return spark.createDataFrame([("/p/f", i * 100, i + 1, t) for i, t in enumerate(texts)], "source_path string, byte_offset long, line_number long, text string")


def test_json(spark):
    texts = [
        '{"ts": "2026-09-01T10:00:00Z", "lvl": 1, "level": "err", "msg": "m", "service.name": "a", "traceId": "t", "duration": "12.5", "status": 200.0, "k": {"a": 1}}',
        '{"timestamp": 1756710738000, "service": {"name": "nested"}, "log": {"level": "warn"}, "message": "x"}', "not json", "[1, 2]", "   ", '{"timestamp": "2026"}', '{"time": 1756710738, "message": "' + "y" * 9000 + '"}',
    ]
    rows = formats.parse_json(lines_of(spark, *texts), Source("alias")).orderBy("line_number").collect()
    assert [r["line_number"] for r in rows] == [1, 2, 3, 4, 6, 7]
    a, b, c, d, e, f = rows
    assert (a["severity"], a["message"], a["service"], a["trace_id"], a["duration_ms"], a["status_code"], a["raw_format"], a["source_alias"]) == ("ERROR", "m", "a", "t", 12.5, 200, "json", "alias")
    assert json.loads(a["attributes_json"]).keys() == {"lvl", "k"}
    assert a["timestamp"].isoformat() == "2026-09-01T10:00:00"
    assert (b["severity"], b["timestamp"].isoformat()) == ("WARN", "2025-09-01T07:12:18")
    assert [(r["severity"], r["unstructured"], r["message"]) for r in (c, d)] == [("UNKNOWN", True, "not json"), ("UNKNOWN", True, "[1, 2]")]
    assert e["timestamp"] is None
    assert f["message"] == "y" * 8000 + "..."
    assert len({r["event_id"] for r in rows}) == 6


def test_json_array(spark):
    files = spark.createDataFrame([("/a", '[{"level": "INFO", "message": "one"}, 5, {"level": "ERROR"}]'), ("/b", "nothing"), ("/c", "[{")], "source_path string, content string")
    rows = formats.parse_json_array(files).orderBy("line_number").collect()
    assert [(r["source_path"], r["severity"]) for r in rows] == [("/a", "INFO"), ("/a", "ERROR")]
    assert {r[0]: r[1] for r in formats.array_problems(files).collect()} == {"/b": "not a JSON array", "/c": "invalid JSON"}


def test_repeated_objects_of_a_json_array_are_kept(spark, tmp_path):
    text = '[{"message": "x"}, {"message": "x"},\n 5, "a, {\\"[", {"message":"y", "é": [{"message":"y"}]}, {"message":"y"}, {"message": "x"}]'
    (tmp_path / "a.json").write_text(text)
    store = EventStore(spark, str(tmp_path / "store"))
    first = ingest(spark, store, str(tmp_path / "a.json"))
    assert (first.total, first.inserted) == (5, 5)
    assert ingest(spark, store, str(tmp_path / "a.json")).inserted == 0
    rows = store.events().orderBy("line_number").collect()
    assert [r["message"] for r in rows] == ["x", "x", "y", "y", "x"]
    assert [r["byte_offset"] for r in rows] == [text.index("{"), text.index("{", 2), text.index('{"message":"y", '), text.rindex('{"message":"y"}'), text.rindex("{")]
    assert len({r["event_id"] for r in rows}) == 5


def test_large_json_arrays_are_reported(spark, tmp_path, monkeypatch):
    module = importlib.import_module("sparklog.sources.parsers")
    read = module.whole_files
    monkeypatch.setattr(module, "whole_files", lambda spark, paths: read(spark, paths, 40))
    (tmp_path / "small.json").write_text('[{"message": "x"}]')
    (tmp_path / "large.json").write_text(json.dumps([{"message": "x"}] * 9))
    result = ingest(spark, EventStore(spark, str(tmp_path / "store")), str(tmp_path / "*.json"))
    assert (result.total, result.inserted) == (1, 1)
    assert {k.rsplit("/", 1)[-1]: v for k, v in result.problems.items()} == {"large.json": "file is larger than 67108864 bytes"}


@pytest.mark.parametrize("text", ["[]", " [ ]", "[1]", '[{"a": "\\\\"}, {"b": "\\""}, [1, {}], null, -1.5e3, "x]"]', "[{'a': ','}, {}]"])
def test_places_of_array_items(text):
    places = formats.item_places(text)
    if "'" in text:
        assert places == [1, 13]
        return
    items = json.loads(text)
    assert [json.JSONDecoder().raw_decode(text, k)[0] for k in places] == items


def test_csv(spark):
    rows = formats.parse_csv(lines_of(spark, '2026-09-01T10:00:00,"hello, ""world""",7', "2026,short", "", "1,2,3,4"), ["ts", "message", "extra"]).orderBy("line_number").collect()
    assert [r["message"] for r in rows] == ['hello, "world"', "short", "2"]
    assert rows[0]["raw_text"] == '2026-09-01T10:00:00,hello, "world",7'
    assert rows[0]["timestamp"].isoformat() == "2026-09-01T10:00:00"
    assert rows[1]["timestamp"] is None
    assert json.loads(rows[1]["attributes_json"]) == {"extra": None}


def test_text_forms(spark):
    texts = [
        "2026-09-01 14:32:18,5 ERROR [payments] it broke", "[2026-09-01 14:32:18] [WARN] careful", "Sep  1 14:32:18 web1 app[3]: started", '127.0.0.1 - - [01/Sep/2026:14:32:18 +0200] "GET /x HTTP/1.1" 404 12 "-" "curl"',
        "2026-09-01 14:32:18 AUDIT my.logger - said", "just a plain line",
    ]
    a, b, c, d, e, f = formats.parse_text(lines_of(spark, *texts)).orderBy("line_number").collect()
    assert (a["severity"], a["service"], a["message"], a["timestamp"].isoformat()) == ("ERROR", "payments", "it broke", "2026-09-01T14:32:18.500000")
    assert (b["severity"], b["message"]) == ("WARN", "careful")
    assert (c["host"], c["service"], c["message"], c["timestamp"].isoformat()) == ("web1", "app[3]", "started", "1900-09-01T14:32:18")
    assert (d["host"], d["status_code"], d["severity"], d["message"], d["timestamp"].isoformat()) == ("127.0.0.1", 404, "UNKNOWN", texts[3], "2026-09-01T12:32:18")
    assert (e["logger"], e["severity"], e["message"]) == ("my.logger", "AUDIT", "said")
    assert (f["severity"], f["unstructured"], f["message"]) == ("UNKNOWN", True, "just a plain line")


def test_regex(spark):
    source = Source("s", regex=r"lvl=(?P<l_v>\w+) t=(?P<d>\d+)", field_map={"level": "l_v", "duration_ms": "d"})
    rows = formats.parse_regex(lines_of(spark, "x lvl=err t=12 y", "none"), source).orderBy("line_number").collect()
    assert [(r["severity"], r["duration_ms"], r["unstructured"]) for r in rows] == [("ERROR", 12.0, False), ("UNKNOWN", None, True)]
    assert formats.parse_regex(lines_of(spark, "a"), Source(regex="[")).first()["unstructured"]
    assert formats.parse_regex(lines_of(spark, "a"), Source()).count() == 0


@pytest.mark.parametrize(
    ("lines", "path", "want"),
    [(['{"a": 1}'], "x.jsonl", "jsonl"), (['[{"a": 1},', '{"b": 2}]'], "x", "jsonarray"), (["a,b,c", "1,2,3"], "x.csv", "csv"), (["2026-09-01 10:00:00 INFO x, y, z"], "x.log", "text"), (["plain"], "x", "text"), ([], "x", "text"), (['{"a": 1}', "{bad}"], "x.log", "text")],
)
def test_detect(lines, path, want):
    assert detect(lines, path=path).format == want
    assert detect(lines, "csv", path).format == "csv"


def test_event_ids(spark):
    def own(path="/p", raw="x", offset=0, line=1):
        return spark.range(1).select(event_id(F.lit(path), F.lit(raw), F.lit(offset).cast("long"), F.lit(line).cast("long"))).first()[0]

    assert own() == own()
    assert own().startswith("tfevt-")
    assert len({own(), own(path="/q"), own(raw="y"), own(offset=1), own(offset=None), own(offset=None, line=2), own(offset=None, line=None)}) == 7
    assert own(line=2) == own()


def test_signatures(spark):
    cases = {
        "plain text": "plain text", "took 5012ms and 3.5 s": "took <num>ms and <num> s", "id 123e4567-e89b-12d3-a456-426614174000": "id <uuid>", "at 0xdeadBEEF": "at <addr>", "\x1b[31mred\x1b[0m": "red",
        "2026-09-01T10:00:00.5Z x": "<ts> x", 'said "hello world"': 'said "<str>"', "v1 a1b": "v1 a1b", "tok abcdefghij_klmnop-1": "tok <id>", None: "", "z " * 200: ("z " * 200)[:240] + "...",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "m string").select("m", signature(F.col("m")).alias("s")).collect()
    assert {r["m"]: r["s"] for r in rows} == cases


def test_ingest_is_idempotent(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"level": "INFO", "message": "one", "timestamp": "2026-09-01T10:00:00Z"}\nbad\n')
    (logs / "b.csv").write_text("ts,level,message\n2026-09-01T10:00:00,ERROR,two\n")
    (logs / "c.log").write_text("2026-09-01 10:00:00 WARN three\n  more\n")
    (logs / "d.json").write_text('[{"message": "four"}]')
    (logs / "e.bin").write_bytes(b"\x00\x01")
    store = EventStore(spark, str(tmp_path / "store"))
    first = ingest(spark, store, str(logs))
    assert (first.total, first.inserted, first.unstructured) == (5, 5, 1)
    assert list(first.problems.values()) == ["binary file"]
    assert ingest(spark, store, str(logs)).inserted == 0
    assert sorted(r["message"] for r in store.events().collect()) == ["bad", "four", "one", "three\n  more", "two"]
    sources = {r["path"].rsplit("/", 1)[-1]: r for r in store.sources().collect()}
    assert (sources["a.jsonl"]["total_events"], sources["a.jsonl"]["inserted_events"], sources["b.csv"]["parser"]) == (4, 2, "csv")
    store.delete_source(sources["a.jsonl"]["path"])
    assert store.events().count() == 3
    assert store.sources().count() == 3


ZONES = ("UTC", "America/Los_Angeles", "Asia/Kolkata")


@pytest.fixture(params=ZONES)
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def micros(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1_000_000)


def test_times_are_utc_in_any_session(spark, zone):
    texts = {
        "2026-03-08 02:30:00": "2026-03-08T02:30:00", "2026-03-08": "2026-03-08", "2026-03-08T02:30": "2026-03-08T02:30:00", "2026-03-08 02": "2026-03-08T02:00:00", "2026-03-08T02:30+0100": "2026-03-08T01:30:00", "2026-03-08T02:30:00,25": "2026-03-08T02:30:00.25", "2026/03/08 02:30:00": "2026-03-08T02:30:00",
        "Mar  8 02:30:00": "1900-03-08T02:30:00", "08/Mar/2026:02:30:00 +0100": "2026-03-08T01:30:00", "2026-03-08T02:30:00+05": "2026-03-07T21:30:00", "2026-03-08 02:30:00Z": "2026-03-08T02:30:00", "2026": None, "x": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.unix_micros(text_timestamp(F.col("t"))).alias("m")).collect()
    assert {r["t"]: r["m"] for r in rows} == {t: None if w is None else micros(w) for t, w in texts.items()}
    when = spark.range(1).select(F.timestamp_micros(F.lit(micros("2026-03-08T02:31:07.000005"))).alias("t"))
    assert tuple(when.select(utc_text(F.col("t")), utc_date(F.col("t")).cast("string")).first()) == ("2026-03-08T02:31:07.000005", "2026-03-08")
    for unit, start in {"second": "2026-03-08T02:31:07", "minute": "2026-03-08T02:31:00", "five_minutes": "2026-03-08T02:30:00", "hour": "2026-03-08T02:00:00", "day": "2026-03-08"}.items():
        assert when.select(F.unix_micros(bucket(F.col("t"), unit))).first()[0] == micros(start)


def test_date_pruning_keeps_rows_in_any_session(spark, zone, tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_text("".join(json.dumps({"timestamp": f"2024-01-05 {h:02d}:00:00", "message": str(h)}) + "\n" for h in (0, 1, 2, 9, 23)))
    store = EventStore(spark, str(tmp_path / "store"))
    assert ingest(spark, store, str(log)).inserted == 5
    for query, n in {'ts <= "2024-01-05T02:00:00"': 3, 'ts > "2024-01-05T09:00:00Z"': 1, 'ts = "2024-01-05T01:00:00"': 1, 'ts < "2024-01-04T20:30:00-04:00"': 1}.items():
        assert frame(store.events(), query).count() == n
    assert [str(r[0]) for r in store.events().select("event_date").distinct().collect()] == ["2024-01-05"]


def test_large_files_are_not_read_whole_to_judge_them(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"message": "x"}\n' * 50)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
    try:
        found = list(fingerprints(spark, str(tmp_path), small=100))
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r["format"], r["size"]) for r in found] == [("jsonl", 850)]
    assert found == [r | {"score": 1.0} for r in fingerprints(spark, str(tmp_path))]


def test_ingest_scans_each_file_twice(spark, tmp_path, monkeypatch):
    module = importlib.import_module("sparklog.sources.lines")
    scans, read = [], module._raw
    monkeypatch.setattr(module, "_raw", lambda *a: scans.append(a) or read(*a))
    (tmp_path / "a.log").write_text("2026-09-01 10:00:00 WARN three\n  more\n" * 5)
    assert ingest(spark, EventStore(spark, str(tmp_path / "store")), str(tmp_path / "a.log")).inserted == 5
    assert len(scans) == 2


@pytest.mark.parametrize("start", [0, 3, 8, 10, 14, 100])
def test_start_offset(spark, tmp_path, start):
    data = b"alpha\r\nbe\ngamma\n\nlast"
    (tmp_path / "f").write_bytes(data)
    want = [(start + at, n, text) for at, n, text in brute(data[start:])]
    assert sorted(tuple(r)[1:] for r in read_lines(spark, str(tmp_path), start_offset=start).collect()) == want


def test_regex_names_and_backreferences(spark):
    source = Source("s", regex=r"(?P<a_b>\w)(?P<ab>\w)(?P=a_b) \(?P<(?P<user_id>\d+)", field_map={"level": "ab", "service": "user_id"})
    rows = formats.parse_regex(lines_of(spark, "xyx (P<77", "xyz (P<77"), source).orderBy("line_number").collect()
    assert [(r["severity"], r["service"], r["unstructured"]) for r in rows] == [("Y", "77", False), ("UNKNOWN", None, True)]
    assert formats.parse_regex(lines_of(spark, "ab"), Source(regex=r"(a)(?(1)b|c)")).first()["unstructured"]  # Java has no conditionals


def test_formats_can_be_registered(spark, tmp_path):
    def parse(lines, header, source):
        return formats.parse_text(lines.withColumn("text", F.concat(F.lit("2026-09-01 10:00:00 WARN "), F.substring("text", 3, 100))), source)

    parsers.register("angle", parse, lambda lines: float(bool(lines) and all(x.startswith("> ") for x in lines)))
    try:
        (tmp_path / "a.log").write_text("> one\n> two\n")
        store = EventStore(spark, str(tmp_path / "store"))
        assert ingest(spark, store, str(tmp_path / "a.log")).files[0].detection.format == "angle"
        assert sorted((r["severity"], r["message"]) for r in store.events().collect()) == [("WARN", "one"), ("WARN", "two")]
    finally:
        del parsers.PARSERS["angle"], SCORES["angle"]
    with pytest.raises(ValueError):
        list(inspect(spark, str(tmp_path), "angle"))


def test_replaced_files_are_noticed(spark, tmp_path):
    log, store = tmp_path / "a.jsonl", EventStore(spark, str(tmp_path / "store"))
    log.write_text('{"message": "one"}\n')
    ingest(spark, store, str(log))
    with log.open("a") as f:
        f.write('{"message": "two"}\n')
    grown = ingest(spark, store, str(log))
    assert (grown.replaced, grown.inserted) == ([], 1)
    log.write_text('{"message": "new"}\n' * 3)
    changed = ingest(spark, store, str(log), drop_replaced=True)
    assert (changed.replaced, changed.inserted, store.events().count()) == ([str(log)], 3, 3)


def test_source_table_and_compaction(spark, tmp_path):
    log, store = tmp_path / "a.jsonl", EventStore(spark, str(tmp_path / "store"))
    for k in range(4):
        with log.open("a") as f:
            f.write(json.dumps({"message": f"m{k}", "timestamp": "2026-09-01T10:00:00Z" if k % 2 else None}) + "\n")
        ingest(spark, store, str(log))
    row = store.get_source(str(log)).first()
    assert (row["enabled"], row["inserted_events"], row["total_events"], row["source_id"]) == (True, 4, 10, store.source_id(str(log)))
    store.set_enabled(str(log), False)
    store.progress(str(log), parse_errors=2, last_byte_offset=7)
    row = store.list_sources().first()
    assert (row["enabled"], row["parse_errors"], row["last_byte_offset"], row["parser"]) == (False, 2, 7, "jsonl")
    with pytest.raises(ValueError):
        store.progress(str(log), nope=1)
    before = sorted(map(tuple, store.events().collect()), key=str)
    assert store.compact(1) == 2
    assert sorted(map(tuple, store.events().collect()), key=str) == before
    assert store.compact(1) == 0
    assert ingest(spark, store, str(log)).inserted == 0
