"""An external search backend: what it knows about a task, and whether that may be trusted."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from codeloom.sources import services

COMPACT, FULL = 8, 16


@dataclass
class Evidence:
    """Candidates of a backend in order: files with a location each, and how many were left out."""

    provider: str | None = None
    candidates: list[dict] = field(default_factory=list)
    total: int = 0
    omitted: int = 0


def normalise(value: object, most: int = FULL) -> Evidence:
    """Candidates of an answer in whatever wrapper: semantic results first, then keyword results, each file once.

    A row is an object with file (or path, file_path); symbol, start_line, end_line and
    score are kept where they are given.
    """
    value = services.unwrap(value)
    provider, lists = None, [value] if isinstance(value, list) else []
    if isinstance(value, dict):
        provider = value.get("provider")
        lists = [value[k] for k in ("semantic_results", "candidates", "results", "matches", "files") if isinstance(value.get(k), list)]
    seen: dict[str, dict] = {}
    for row in (r for rows in lists for r in rows):
        row = {"file": row} if isinstance(row, str) else row
        if not isinstance(row, dict):
            continue
        file = next((row[k] for k in ("file", "path", "file_path") if isinstance(row.get(k), str)), None)
        if file:
            seen.setdefault(file.removeprefix("./"), {"file": file.removeprefix("./")} | {k: row[k] for k in ("symbol", "start_line", "end_line", "score") if k in row})
    found = list(seen.values())
    return Evidence(provider if isinstance(provider, str) else None, found[:most], len(found), max(0, len(found) - most))


def evidence(command: list[str] | None = None, text: str | None = None, path: str | None = None, most: int = FULL, deadline: float = 30.0) -> Evidence | None:
    """Evidence of a command's output, of a JSON text or of a file; at most one of them. None without any."""
    given = [n for n, v in (("command", command), ("text", text), ("path", path)) if v]
    if len(given) > 1:
        raise ValueError(f"backend evidence comes from one of {', '.join(given)}")
    if command:
        return normalise(services.command_json(command, deadline), most)
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    if text is None:
        return None
    try:
        return normalise(json.loads(text), most)
    except json.JSONDecodeError as e:
        raise ValueError(f"backend evidence: {e}") from e


def freshness(current: str | None, cached: str | None = None, *, forced: bool = False, head: str | None = None, indexed_head: str | None = None, dirty: bool = False, indexed: bool = True, lost: int = 0) -> str:
    """State of a backend's index against the working tree.

    ``current`` and ``cached`` are fingerprints of the tree now and when the backend last
    indexed it; ``head`` and ``indexed_head`` are commits; ``lost`` candidates name files
    that are not there.
    """
    if forced:
        return "forced"
    if current is None:
        return "non_git"
    if not indexed:
        return "missing"
    if lost:
        return "stale_candidates"
    if cached is not None:
        return "cached" if cached == current else "changed"
    if indexed_head is None:
        return "unverified"
    if dirty:
        return "dirty"
    return "head_match" if indexed_head == head else "stale"
