"""Captures of compiled queries: what was asked, of which catalog, in which context, and what came out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from marlstone.operators.calendar import TimeContext
from marlstone.plans.errors import CompileError
from marlstone.plans.rows import Bound

VERSION, MOST_BYTES = 1, 256 * 1024


def contract(bound: Bound) -> list[list[str | None]]:
    """Aliases, types and units of a result."""
    return [[s.alias, s.type.simpleString(), s.unit] for s in bound.slots]


def capture(engine, query: Mapping, bound: Bound, context: TimeContext | None = None) -> dict:
    """A JSON record that ``replay`` checks against."""
    body = {
        "version": VERSION, "snapshot": engine.catalog.current.id, "query": query, "contract": contract(bound), "relations": sorted(bound.relations),
        "context": None if context is None else {"instant": context.instant.isoformat(), "zone": context.zone, "calendar": context.calendar},
    }
    text = json.dumps(body, sort_keys=True)
    if len(text) > MOST_BYTES:
        raise CompileError("capture_limit")
    return body | {"digest": hashlib.sha256(text.encode()).hexdigest()}


def replay(engine, record: Mapping, allowed: set[str] | None = None) -> Bound:
    """Compile a captured query again; anything that differs is an error."""
    import datetime as dt

    body = {k: v for k, v in record.items() if k != "digest"}
    if record.get("version") != VERSION:
        raise CompileError("replay_version")
    if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() != record.get("digest"):
        raise CompileError("replay_capture_invalid")
    if record["snapshot"] != engine.catalog.current.id:
        raise CompileError("snapshot_mismatch")
    c = record["context"]
    context = None if c is None else TimeContext(dt.datetime.fromisoformat(c["instant"]), c["zone"], c["calendar"])
    make = engine.graph if "nodes" in record["query"] else engine.rows
    bound = make(record["query"], allowed=allowed, context=context)
    if contract(bound) != [list(x) for x in record["contract"]]:
        raise CompileError("replay_mismatch")
    return bound
