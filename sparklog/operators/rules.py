"""Alert rules: each is a function of events, configuration and `now` to a DataFrame of alerts.

A rule is one aggregation; windows that it compares are conditional counts in the same pass, and its conditions are
filters on the aggregate, so an alert is a row and nothing runs until it is asked for. Alert ids depend only on the
rule, the workspace and the scope. `register` adds rules.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.functions import as_utc, is_error, moment, signature, utc_text
from sparklog.operators.analytics import between, error_signatures

ALERT_COLUMNS = ("id", "rule_id", "rule_name", "severity", "fired_at", "title", "explanation", "threshold", "observed", "time_window", "scope")
MOST_SIGNATURES = 50
# The format of alert ids.
ALERT_ID_PREFIX, ALERT_ID_DIGITS = "tfal-", 16


@dataclass(frozen=True)
class RuleConfig:
    name: str
    rule_id: str
    enabled: bool = True
    severity: str = "NOTICE"
    parameters: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Context:
    """known: signature and first_seen of all errors (EventStore.known_signatures); None: found from the events."""

    events: DataFrame
    config: RuleConfig
    now: datetime
    workspace_id: str = ""
    known: DataFrame | None = None

    def get(self, name: str) -> Any:
        return self.config.parameters.get(name, DEFAULTS[self.config.rule_id].get(name))

    def ago(self, minutes: float) -> datetime:
        return self.now - timedelta(minutes=minutes)

    def within(self, start: datetime, end: datetime | None = None) -> Column:
        return between(self.events, start, end)

    def text(self, time: str) -> Column:
        """A time that comes from the events' timestamps, as ISO text in UTC."""
        return utc_text(as_utc(F.col(time), self.events.schema["timestamp"].dataType))


Rule = Callable[[Context], DataFrame]
RULES: dict[str, Rule] = {}
NAMES = {"error_rate_spike": "Error rate spike", "new_error_signature": "New error signature", "latency_threshold": "Latency threshold", "event_burst": "Event volume burst", "missing_heartbeat": "Missing heartbeat"}
DEFAULTS: dict[str, dict[str, Any]] = {
    "error_rate_spike": {"window_min": 5, "baseline_min": 30, "threshold_multiple": 3.0, "min_errors": 20},
    "new_error_signature": {"window_min": 60},
    "latency_threshold": {"window_min": 5, "threshold_ms": 1000.0},
    "event_burst": {"window_min": 5, "baseline_min": 60, "factor": 4.0},
    "missing_heartbeat": {"silence_min": 10},
}


def register(rule_id: str, **defaults: Any) -> Callable[[Rule], Rule]:
    """Add a rule under its id, with defaults of its parameters."""

    def add(rule: Rule) -> Rule:
        RULES[rule_id] = rule
        DEFAULTS.setdefault(rule_id, defaults)
        return rule

    return add


def available_rules() -> list[str]:
    return sorted(RULES)


def default_rules() -> list[RuleConfig]:
    """The five rules; only new error signatures are on."""
    severities = {"error_rate_spike": "WARNING", "new_error_signature": "NOTICE", "latency_threshold": "WARNING", "event_burst": "NOTICE", "missing_heartbeat": "INFO"}
    return [RuleConfig(NAMES[r], r, r == "new_error_signature", severities[r], dict(DEFAULTS[r])) for r in severities]


def alert_id(*parts: Column | str | None) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat(F.lit(ALERT_ID_PREFIX), F.substring(F.sha1(F.concat_ws("|", *texts)), 1, ALERT_ID_DIGITS))


def _alerts(ctx: Context, found: DataFrame, identity: list[Column | str | None], title: Column, explanation: Column, threshold: str, observed: Column, window: str | None, scope: dict[str, Column]) -> DataFrame:
    """found as alert rows."""
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in scope.items()]), lambda e: e["v"].isNotNull())) if scope else F.create_map().cast("map<string,string>")
    return found.select(
        alert_id(ctx.config.rule_id, ctx.workspace_id, *identity).alias("id"), F.lit(ctx.config.rule_id).alias("rule_id"), F.lit(NAMES.get(ctx.config.rule_id, ctx.config.name)).alias("rule_name"),
        F.lit(ctx.config.severity).alias("severity"), moment(ctx.now, T.TimestampType()).alias("fired_at"), title.alias("title"), explanation.alias("explanation"), F.lit(threshold).alias("threshold"),
        observed.alias("observed"), F.lit(window).cast("string").alias("time_window"), pairs.alias("scope"),
    )


def error_rate_counts(ctx: Context) -> DataFrame:
    """One row of recent and baseline totals and errors, if the error rate rose enough."""
    w, b, service = ctx.get("window_min"), ctx.get("baseline_min"), ctx.get("service")
    recent, base = ctx.within(ctx.ago(w), ctx.now), ctx.within(ctx.ago(w + b), ctx.ago(w))
    rows = ctx.events.filter(ctx.within(ctx.ago(w + b), ctx.now))
    if service:
        rows = rows.filter(F.col("service") == service)
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in {"total_now": recent, "errors_now": recent & is_error(), "total_base": base, "errors_base": base & is_error()}.items()])
    rates = counts.withColumns({"rate_now": F.coalesce(F.try_divide("errors_now", "total_now"), F.lit(0.0)), "rate_base": F.coalesce(F.try_divide("errors_base", "total_base"), F.lit(0.0))})
    return rates.filter((F.col("errors_now") >= int(ctx.get("min_errors"))) & (F.col("rate_base") > 0) & (F.col("rate_now") >= F.col("rate_base") * float(ctx.get("threshold_multiple"))))


@register("error_rate_spike")
def error_rate_spike(ctx: Context) -> DataFrame:
    """The error rate of the last minutes is a multiple of the baseline before them."""
    w, multiple, least, service = int(ctx.get("window_min")), float(ctx.get("threshold_multiple")), int(ctx.get("min_errors")), ctx.get("service")
    now, base = F.format_number(100 * F.col("rate_now"), 2), F.format_number(100 * F.col("rate_base"), 2)
    explanation = F.format_string(f"%s%% of the events of the last {w} min are errors, against %s%% before: {multiple:.1f} times as many or more, and no fewer than {least} errors.", now, base)
    observed = F.format_string("%s%% (%d errors / %d events)", now, "errors_now", "total_now")
    title = F.lit("Error rate spike" + (f" in service {service}" if service else ""))
    return _alerts(ctx, error_rate_counts(ctx), [ctx.ago(w).isoformat(), service], title, explanation, f"{multiple:.1f}x baseline, >= {least} errors", observed, f"{w} min", {"service": F.lit(service)} if service else {})


def new_signatures(ctx: Context) -> DataFrame:
    """signature, first_seen of error signatures in the window that no earlier error has."""
    start = ctx.ago(ctx.get("window_min"))
    if ctx.known is not None:  # only the window's errors are read
        found = error_signatures(ctx.events.filter(ctx.within(start))).select("signature", "first_seen").filter("signature <> ''")
        found = found.join(ctx.known.filter(~between(ctx.known, start, None, "first_seen")).select("signature"), "signature", "left_anti")
        return found.orderBy("first_seen", "signature").limit(MOST_SIGNATURES)
    inside, before = ctx.within(start), ~ctx.within(start)
    messages = ctx.events.filter(is_error() & F.col("timestamp").isNotNull()).groupBy("message").agg(F.count_if(before).alias("old"), F.min(F.when(inside, F.col("timestamp"))).alias("seen"))
    found = messages.groupBy(signature(F.col("message")).alias("signature")).agg(F.sum("old").alias("old"), F.min("seen").alias("first_seen"))
    found = found.filter("old = 0 and first_seen is not null and signature <> ''").drop("old")
    return found.orderBy("first_seen", "signature").limit(MOST_SIGNATURES)


@register("new_error_signature")
def new_error_signature(ctx: Context) -> DataFrame:
    """Error signatures that appear for the first time."""
    s, seen = F.col("signature"), ctx.text("first_seen")
    explanation = F.concat(F.lit("No earlier error has this signature: "), s)
    return _alerts(ctx, new_signatures(ctx), [s, seen], F.concat(F.lit("New error signature: "), F.substring(s, 1, 80)), explanation, "First occurrence", F.concat(F.lit("First seen at "), seen), f"{ctx.get('window_min')} min", {"signature": s})


def slow_services(ctx: Context) -> DataFrame:
    """service, n, p95 where at least 5 recent durations have a 95th percentile at the threshold or above."""
    rows = ctx.events.filter(ctx.within(ctx.ago(ctx.get("window_min"))) & F.col("duration_ms").isNotNull())
    counts = rows.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.percentile("duration_ms", F.lit(0.95)).alias("p95"))
    return counts.filter((F.col("n") >= 5) & (F.col("p95") >= float(ctx.get("threshold_ms"))))


@register("latency_threshold")
def latency_threshold(ctx: Context) -> DataFrame:
    """The 95th percentile of a service's durations is too high."""
    limit, name = float(ctx.get("threshold_ms")), F.coalesce("service", F.lit("unknown"))
    explanation = F.format_string(f"p95 duration of %s is %.1f ms over %d events; the threshold is {limit:.1f} ms.", name, "p95", "n")
    return _alerts(ctx, slow_services(ctx), [F.col("service")], F.concat(F.lit("High latency in "), name), explanation, f"p95 >= {limit:.1f} ms", F.format_string("p95 %.1f ms", "p95"), f"{ctx.get('window_min')} min", {"service": F.col("service")})


def burst_counts(ctx: Context) -> DataFrame:
    """One row of recent and baseline counts, if the recent one is a multiple of the baseline's share."""
    w, b = ctx.get("window_min"), ctx.get("baseline_min")
    recent, base = ctx.within(ctx.ago(w), ctx.now), ctx.within(ctx.ago(w + b), ctx.ago(w))
    counts = ctx.events.filter(ctx.within(ctx.ago(w + b), ctx.now)).agg(F.count_if(recent).alias("recent"), F.count_if(base).alias("base"))
    counts = counts.withColumn("expected", F.col("base") * float(w) / max(1, b))
    return counts.filter((F.col("base") > 0) & (F.col("recent") >= F.col("expected") * float(ctx.get("factor"))))


@register("event_burst")
def event_burst(ctx: Context) -> DataFrame:
    """Far more events than the baseline makes one expect."""
    factor, w = float(ctx.get("factor")), ctx.get("window_min")
    explanation = F.format_string(f"%d events in the last {w} minute(s); %.1f were expected. Triggered at {factor:.1f}x.", "recent", "expected")
    return _alerts(ctx, burst_counts(ctx), [ctx.ago(w).isoformat()], F.lit("Event volume burst"), explanation, f"{factor:.1f}x baseline", F.format_string("%d events", "recent"), f"{w} min", {})


def silent_services(ctx: Context) -> DataFrame:
    """service, last_seen of services whose last event is too long ago."""
    last = ctx.events.filter("timestamp is not null").groupBy("service").agg(F.max("timestamp").alias("last_seen"))
    return last.filter(~between(last, ctx.ago(ctx.get("silence_min")), None, "last_seen"))


@register("missing_heartbeat")
def missing_heartbeat(ctx: Context) -> DataFrame:
    """A service has gone silent."""
    name, minutes, seen = F.coalesce("service", F.lit("unknown")), ctx.get("silence_min"), ctx.text("last_seen")
    explanation = F.format_string(f"No event of %s since %s; expected one every {minutes} minute(s).", name, seen)
    return _alerts(ctx, silent_services(ctx), [F.col("service")], F.concat(F.lit("No events from "), name), explanation, f"{minutes} min of silence", F.concat(F.lit("Last seen at "), seen), f"{minutes} min", {"service": F.col("service")})


@dataclass(frozen=True)
class Evaluation:
    alerts: list[dict[str, Any]]
    failures: dict[str, str]  # rule id to message


def run_all(events: DataFrame, rules: Iterable[RuleConfig], now: datetime | None = None, workspace_id: str = "", known: DataFrame | None = None) -> Evaluation:
    """Alerts of all enabled known rules; a rule that fails does not stop the others and is reported."""
    when, alerts, failures = now or datetime.now(UTC), [], {}
    for config in rules:
        if not config.enabled or config.rule_id not in RULES:
            continue
        try:
            alerts += [r.asDict() for r in RULES[config.rule_id](Context(events, config, when, workspace_id, known)).collect()]  # a row a service or signature
        except (PySparkException, ValueError, TypeError) as e:
            failures[config.rule_id] = str(e)
    return Evaluation(alerts, failures)
