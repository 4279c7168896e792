import json

import pytest

from sparklog import cli, demo, driver_queries, export, workspace
from sparklog.operators.rules import RuleConfig

SF = "/root/testdata/sf0.001"


def test_export(spark, tmp_path):
    events = driver_queries.events(spark, SF)
    for fmt in export.FORMATS:
        export.export_query(events, "level = ERROR | sort line_number | limit 5", str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 5
    rows = [json.loads(x) for f in (tmp_path / "jsonl").glob("part-*") for x in f.read_text().splitlines()]
    assert len(rows) == 5 and "logger" in rows[0] and rows[0]["timestamp"].startswith("2024-01")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    with pytest.raises(ValueError):
        export.export(events, str(tmp_path / "x"), "xlsx")


def test_report(spark):
    report = export.session_report(driver_queries.events(spark, SF), [{"severity": "INFO", "title": "a|b"}])
    assert report["events"] == 1000 and sum(report["severity"].values()) == 1000
    assert json.loads(export.report_json(report))["top_services"]
    assert "| INFO | a\\|b |" in export.report_markdown(report)


def test_workspace(tmp_path):
    path = tmp_path / "w.json"
    w = workspace.new_workspace("mine").with_query("q", "a").with_query("q", "b").with_rule(RuleConfig("r", "event_burst"))
    workspace.save_workspace(w, path)
    back = workspace.load_workspace(path)
    assert (back.workspace_id, back.name, [q.query for q in back.saved_queries], back.rules[0].rule_id) == (w.workspace_id, "mine", ["b"], "event_burst")
    raw = json.loads(path.read_text())
    del raw["workspace_id"]
    path.write_text(json.dumps(raw | {"version": 1}))
    assert workspace.load_workspace(path).workspace_id == workspace.load_workspace(path).workspace_id
    assert workspace.load_workspace(path).workspace_id.startswith("ws-v1-")
    for bad in (raw | {"nope": 1}, raw | {"workspace_id": "x"}, []):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            workspace.load_workspace(path)


def test_demo_and_cli(spark, tmp_path, capsys):
    assert demo.demo_events(spark, 100).collect() == demo.demo_events(spark, 100).collect()
    assert demo.demo_events(spark, 100, seed=1).collect() != demo.demo_events(spark, 100).collect()
    folder = str(tmp_path / "demo")
    assert cli.main(["generate-demo", folder, "--events", "200"]) == 0
    capsys.readouterr()
    assert cli.main(["--json", "query", folder, "| stats count() by service | sort service"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["rows"] == [[s, 40] for s in sorted(demo.SERVICES)]
    assert cli.main(["query", folder, "nope = 1"]) == 3
    capsys.readouterr()
    assert cli.main(["--json", "inspect", folder, "--limit", "7"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["file_count"], found["events"], len(found["sample"]), found["parser"]) == (5, 40, 7, "jsonl")
    assert sum(found["severity"].values()) == 40
    own = ["--parser", "custom_regex", "--regex", r'"level":"(?P<l>\w+)"', "--field", "level=l"]
    assert cli.main(["--json", "query", folder, "level != UNKNOWN | stats count()", *own]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [[200]]
    assert cli.main(["report", folder]) == 0
    assert cli.main(["inspect", str(tmp_path / "none")]) == 2
    assert cli.main(["validate-query", "level = ERROR"]) == 0
    assert cli.main(["validate-query", "level ="]) == 1
    assert cli.main(["version"]) == 0
    assert cli.main(["launch"]) == 1
    path = tmp_path / "w.json"
    workspace.save_workspace(workspace.new_workspace("mine").with_query("q", "level = ERROR"), path)
    capsys.readouterr()
    assert cli.main(["--json", "workspace-info", str(path)]) == 0
    assert json.loads(capsys.readouterr().out)["saved_queries"][0]["query"] == "level = ERROR"
    path.write_text("[]")
    assert cli.main(["workspace-info", str(path)]) == 2


def test_demo_without_incidents(spark):
    assert demo.demo_events(spark, 1000, incidents=False).filter("exception_type = 'CircuitOpenError'").count() == 0
    assert demo.demo_events(spark, 1000).filter("exception_type = 'CircuitOpenError'").count() == 1
