"""From requests in words to compiled queries: a provider proposes, the compiler decides, and its diagnostics go back for repair."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Protocol

from marlstone.plans.errors import CompileError
from marlstone.plans.rows import Bound


class Provider(Protocol):
    """Turns a request and its context into a proposal: ``{"status": "query" | "graph", "query": ...}``, ``{"status": "needs_clarification", "question": ...}`` or ``{"status": "unsupported", "reason": ...}``."""

    def propose(self, request: str, context: Mapping, diagnostics: list[Mapping]) -> Mapping: ...


class Scripted:
    """A provider that answers from a list, for tests and demonstrations."""

    def __init__(self, answers: Iterable[Mapping]):
        self.answers, self.seen = iter(answers), []

    def propose(self, request: str, context: Mapping, diagnostics: list[Mapping]) -> Mapping:
        self.seen.append(list(diagnostics))
        try:
            return next(self.answers)
        except StopIteration:
            return {"status": "unsupported", "reason": "no answer is left"}


@dataclass
class Answer:
    outcome: str  # compiled, needs_clarification, unsupported, rejected, provider_failure
    bound: Bound | None = None
    message: str = ""
    attempts: int = 1


def context_for(engine, request: str, limit: int = 16) -> dict:
    """The objects of the catalog that the request's words lead to, with the fields of their relations."""
    snapshot = engine.catalog.current
    hits = engine.catalog.search(request, limit)
    names = {n.split(".")[0] for _, n, _ in hits} or set(list(snapshot.relations)[:limit])
    return {
        "snapshot": snapshot.id,
        "relations": {n: {f.name: f.dataType.simpleString() for f in snapshot.relations[n].schema} for n in sorted(names)},
        "objects": [{"kind": k, "name": n} for k, n, _ in hits if k != "field"],
    }


def interpret(engine, request: str, provider: Provider, repairs: int = 2, **options) -> Answer:
    """Ask the provider, compile what it proposes, and let it repair at most ``repairs`` times."""
    context, diagnostics = context_for(engine, request), []
    for attempt in range(1, repairs + 2):
        try:
            p = provider.propose(request, context, diagnostics)
            status = p["status"]
        except Exception as e:  # whatever a provider does, it must not take the engine down
            return Answer("provider_failure", message=str(e), attempts=attempt)
        if status in ("needs_clarification", "unsupported"):
            return Answer(status, message=str(p.get("question") or p.get("reason") or ""), attempts=attempt)
        if status not in ("query", "graph"):
            return Answer("provider_failure", message=f"unknown status {status!r}", attempts=attempt)
        try:
            return Answer("compiled", (engine.graph if status == "graph" else engine.rows)(p["query"], **options), attempts=attempt)
        except CompileError as e:
            diagnostics.append({"code": e.code, "requirement": e.requirement, "message": str(e)})
        except (KeyError, TypeError, AttributeError) as e:
            diagnostics.append({"code": "invalid_requirement", "requirement": None, "message": repr(e)})
    return Answer("rejected", message=diagnostics[-1]["message"], attempts=repairs + 1)
