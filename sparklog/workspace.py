"""Workspaces: named settings, sources, saved queries and rules in a JSON file (format 2; files without an id are format 1)."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from sparklog.operators.rules import RuleConfig

# The version, field names and defaults of the file format.
VERSION = 2


@dataclass(frozen=True)
class SourceConfig:
    path: str
    alias: str = ""
    enabled: bool = True
    parser_override: str | None = None
    custom_regex: str | None = None
    custom_field_map: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class SavedQuery:
    name: str
    query: str
    created_at: str
    last_run_at: str | None = None


@dataclass(frozen=True)
class Settings:
    theme: str = "dark"
    timezone_display: str = "local"
    default_row_limit: int = 1000
    live_refresh_ms: int = 200
    timestamp_format: str | None = None


@dataclass(frozen=True)
class Workspace:
    name: str
    created_at: str
    updated_at: str
    version: int = VERSION
    workspace_id: str = field(default_factory=lambda: f"ws-{uuid.uuid4().hex[:12]}")
    sources: tuple[SourceConfig, ...] = ()
    saved_queries: tuple[SavedQuery, ...] = ()
    rules: tuple[RuleConfig, ...] = ()
    settings: Settings = Settings()
    notes: str | None = None

    def __post_init__(self):
        if not self.workspace_id.startswith("ws-"):
            raise ValueError("workspace_id must begin with 'ws-'")

    def with_query(self, name: str, query: str) -> Workspace:
        """With the query saved under a name, in place of an earlier one of that name."""
        kept = tuple(q for q in self.saved_queries if q.name != name)
        return replace(self, saved_queries=(*kept, SavedQuery(name, query, _now())))

    def with_rule(self, rule: RuleConfig) -> Workspace:
        kept = tuple(r for r in self.rules if r.name != rule.name)
        return replace(self, rules=(*kept, rule))


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _built(kind: type, values: Any) -> Any:
    if not isinstance(values, dict):
        raise ValueError(f"{kind.__name__}: not a JSON object")
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{kind.__name__}: unknown keys {', '.join(sorted(unknown))}")
    try:
        return kind(**values)
    except TypeError as e:
        raise ValueError(f"{kind.__name__}: {e}") from e


def new_workspace(name: str) -> Workspace:
    return Workspace(name, _now(), _now())


def load_workspace(path: str | Path) -> Workspace:
    """Read a workspace; a file of format 1 gets an id from its path."""
    p = Path(path)
    raw = json.loads(p.read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ValueError("invalid workspace file: not a JSON object")
    if "workspace_id" not in raw:
        raw |= {"workspace_id": f"ws-v1-{hashlib.sha256(str(p.resolve()).encode()).hexdigest()[:12]}", "version": VERSION}
    for name, kind in (("sources", SourceConfig), ("saved_queries", SavedQuery), ("rules", RuleConfig)):
        if name in raw:
            raw[name] = tuple(_built(kind, x) for x in raw[name])
    if "settings" in raw:
        raw["settings"] = _built(Settings, raw["settings"])
    return _built(Workspace, raw)


def save_workspace(workspace: Workspace, path: str | Path) -> Workspace:
    saved = replace(workspace, updated_at=_now())
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(asdict(saved), indent=2, ensure_ascii=False), encoding="utf-8")
    return saved
