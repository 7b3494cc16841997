"""Reads of one state: sessions that hold the written relations at the generations they had at the start.

A session may read relations that aren't versioned tables only if it is told to observe them; its report says what was established.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from marlstone.plans.errors import CompileError
from marlstone.session import Engine

#: Times that the generations of several tables are read until none moves meanwhile.
TRIES = 5


@dataclass
class Report:
    """``established``: ``snapshot`` if every relation below was held, else ``observed``."""

    established: str
    generations: dict[str, int]
    external: list[str] = field(default_factory=list)


class ReadSession:
    """Relations (and all below them) at one state, for ``seconds``; ``external``: ``reject`` or ``observe`` others; ``after``: generations that must have been reached."""

    def __init__(self, engine: Engine, names: list[str], seconds: float = 300.0, external: str = "reject", after: dict[str, int] | None = None):
        if not names or seconds <= 0:
            raise CompileError("read_session", "relations and a positive lifetime")
        self.over, self.closed = time.monotonic() + seconds, False
        snapshot = engine.catalog.current
        below = {d for n in names for d in {n} | engine.dependencies(n)}
        bases = sorted(n for n in below if snapshot.relation(n).kind == "base")
        others = [n for n in bases if n not in engine.bindings]
        if others and external != "observe":
            raise CompileError("read_external", ", ".join(others))
        held = {n: engine.bindings[n] for n in bases if n in engine.bindings}
        if not held:
            raise CompileError("read_session", "no relation is a versioned table")
        if extra := set(after or {}) - set(held):
            raise CompileError("read_receipt", ", ".join(sorted(extra)))
        now = lambda: {n: t.numbers()[-1] for n, t in held.items()}
        pinned = now()
        for _ in range(TRIES):
            # none moved while all were read: they are one state
            if (again := now()) == pinned:
                break
            pinned = again
        else:
            raise CompileError("read_consistency", "the tables keep changing")
        if late := [n for n, g in (after or {}).items() if pinned[n] < g]:
            raise CompileError("read_receipt", ", ".join(late))
        self.engine = Engine(engine.spark)
        for n in bases:
            self.engine.register(n, held[n].read(pinned[n]) if n in held else engine.table(n), snapshot.relation(n).meaning)
        views = [n for n in below if snapshot.relation(n).kind == "view"]
        while views:
            n = next(v for v in views if not set(snapshot.relation(v).dependencies) & set(views))
            self.engine.view(n, snapshot.relation(n).sql, snapshot.relation(n).meaning)
            views.remove(n)
        self.report = Report("observed" if others else "snapshot", pinned, others)

    def check(self) -> Engine:
        if self.closed or time.monotonic() > self.over:
            raise CompileError("read_session", "closed" if self.closed else "expired")
        return self.engine

    def sql(self, text: str, parameters: list | None = None) -> DataFrame:
        return self.check().sql(text, parameters)

    def rows(self, query, **options):
        return self.check().rows(query, **options)

    def graph(self, query, **options):
        return self.check().graph(query, **options)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> "ReadSession":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read(engine: Engine, text: str, consistency: str = "observed", seconds: float = 300.0) -> tuple[DataFrame, Report]:
    """One query with its report; a ``snapshot`` read refuses relations that can't be held, and a query of constants is one."""
    names = sorted(engine.gate(text))
    bases = {n for n in names for n in {n} | engine.dependencies(n) if engine.catalog.current.relation(n).kind == "base"}
    if not bases:
        return engine.sql(text), Report("snapshot", {})
    if consistency == "snapshot":
        session = ReadSession(engine, names, seconds)
        return session.sql(text), session.report
    return engine.sql(text), Report("observed", {n: engine.bindings[n].numbers()[-1] for n in bases if n in engine.bindings}, sorted(bases - set(engine.bindings)))
