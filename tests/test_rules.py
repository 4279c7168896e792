import datetime as dt

import pytest

from sparklog.operators import rules
from sparklog.schema import EVENT_SCHEMA

NOW = dt.datetime(2026, 9, 1, 12, tzinfo=dt.UTC)


@pytest.fixture
def make(spark):
    def events(*rows):
        out = []
        for i, (minutes, severity, service, message, duration) in enumerate(rows):
            base = dict.fromkeys(EVENT_SCHEMA.fieldNames()) | {
                "event_id": f"e{i}", "source_id": 1, "source_alias": "s", "source_path": "/p", "line_number": i + 1, "raw_format": "json", "timestamp": NOW - dt.timedelta(minutes=minutes), "ingested_at": NOW,
                "severity": severity, "message": message, "raw_text": message, "service": service, "duration_ms": duration,
            }
            out.append(tuple(base.values()))
        return spark.createDataFrame(out, EVENT_SCHEMA)

    return events


def run(events, rule, **parameters):
    found = rules.run_all(events, [rules.RuleConfig(rule, rule, parameters=parameters)], NOW, "ws-1")
    assert not found.failures
    return found.alerts


def test_new_error_signature(make):
    fresh = (5, "ERROR", "api", "timeout after 5012 ms", None)
    (alert,) = run(make(fresh), "new_error_signature")
    assert alert["scope"] == {"signature": "timeout after <num> ms"}
    assert alert["id"].startswith("tfal-") and len(alert["id"]) == 21
    assert run(make(fresh, (120, "ERROR", "api", "timeout after 17 ms", None)), "new_error_signature") == []
    assert len(run(make(fresh, (4, "FATAL", "api", "timeout after 99 ms", None)), "new_error_signature")) == 1
    assert run(make((5, "INFO", "api", "x", None)), "new_error_signature") == []


def test_error_rate_spike(make):
    old = [(10 + i / 20, "ERROR" if i % 20 == 0 else "INFO", "api", "m", None) for i in range(300)]
    events = make(*old, *[(1, "ERROR", "api", "m", None)] * 50)
    (alert,) = run(events, "error_rate_spike")
    assert "100.00% (50 errors / 50 events)" in alert["observed"]
    assert run(events, "error_rate_spike", min_errors=1000) == []
    assert run(events, "error_rate_spike", service="other") == []
    assert run(make(*[(1, "INFO", "api", "m", None)] * 20), "error_rate_spike") == []


def test_latency_threshold(make):
    assert [a["scope"] for a in run(make(*[(1, "INFO", "payments", "m", 1500.0)] * 20), "latency_threshold")] == [{"service": "payments"}]
    assert run(make(*[(1, "INFO", "payments", "m", 1500.0)] * 4), "latency_threshold") == []
    assert [a["scope"] for a in run(make(*[(1, "INFO", None, "m", 1500.0)] * 5), "latency_threshold")] == [{}]


def test_event_burst(make):
    old = [(10 + i, "INFO", "api", "m", None) for i in range(20)]
    assert len(run(make(*old, *[(0.2, "INFO", "api", "m", None)] * 200), "event_burst")) == 1
    assert run(make(*[(0.2, "INFO", "api", "m", None)] * 200), "event_burst") == []


def test_missing_heartbeat(make):
    found = run(make((20, "INFO", "payments", "m", None), (1, "INFO", "api", "m", None), (30, "INFO", "api", "m", None)), "missing_heartbeat")
    assert [a["scope"] for a in found] == [{"service": "payments"}]


def test_registry(make):
    events = make((20, "INFO", "payments", "m", None))
    configs = [rules.RuleConfig("a", "missing_heartbeat", enabled=False), rules.RuleConfig("b", "no_such_rule"), rules.RuleConfig("c", "missing_heartbeat", parameters={"silence_min": "x"})]
    found = rules.run_all(events, configs, NOW)
    assert found.alerts == [] and set(found.failures) == {"missing_heartbeat"}
    assert [c.rule_id for c in rules.default_rules() if c.enabled] == ["new_error_signature"]

    @rules.register("always", least=1)
    def always(ctx):
        return rules.RULES["missing_heartbeat"](rules.Context(ctx.events, rules.RuleConfig("h", "missing_heartbeat"), ctx.now))

    try:
        assert "always" in rules.available_rules()
        assert len(run(events, "always")) == 1
    finally:
        del rules.RULES["always"]
