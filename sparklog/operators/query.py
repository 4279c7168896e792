"""Runs piped queries: text to DataFrame (frame), to collected rows (execute), or to a check alone (validate)."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.plans.binder import BASE_LIMIT, MAX_LIMIT, BindError, Bound, bind
from sparklog.plans.language import Query, QuerySyntaxError, parse
from sparklog.schema import DISPLAY


class QueryError(Exception):
    """An error of a query to show to its user."""


@dataclass(frozen=True)
class QueryResult:
    columns: list[str]
    rows: list[tuple]
    is_aggregation: bool
    row_count: int
    elapsed_ms: float
    plan: str
    truncated: bool  # as many rows as the limit lets through


def bound(events: DataFrame | None, query: str | Query, base_limit: int | None = BASE_LIMIT, max_limit: int | None = MAX_LIMIT) -> Bound:
    try:
        return bind(parse(query) if isinstance(query, str) else query, events, base_limit=base_limit, max_limit=max_limit)
    except (QuerySyntaxError, BindError) as e:
        raise QueryError(str(e)) from e


def frame(events: DataFrame, query: str | Query, **limits: int | None) -> DataFrame:
    """The query's result as a DataFrame that has not run."""
    return bound(events, query, **limits).frame


def display(rows: DataFrame) -> DataFrame:
    """The columns of a row result that are shown, under their labels."""
    return rows.select(*[F.col(c).alias(label) for c, label in DISPLAY.items() if c in rows.columns])


def execute(events: DataFrame, query: str | Query, **limits: int | None) -> QueryResult:
    plan = bound(events, query, **limits)
    began = time.perf_counter()
    try:
        rows = [tuple(r) for r in plan.frame.collect()]  # max_limit rows, or a row a group
    except PySparkException as e:
        raise QueryError(f"Query failed: {e}") from e
    took = (time.perf_counter() - began) * 1000
    text = plan.frame._jdf.queryExecution().simpleString()
    return QueryResult(list(plan.columns), rows, plan.is_aggregation, len(rows), took, text, not plan.is_aggregation and plan.limit is not None and len(rows) >= plan.limit)


def validate(query: str) -> tuple[bool, str]:
    """Whether the query has a meaning, and what is wrong or "ok"; needs no session."""
    try:
        bound(None, query)
    except QueryError as e:
        return False, str(e)
    return True, "ok"
