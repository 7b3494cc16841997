"""The governed catalog: relations and what their authors state about them.

A snapshot is immutable, and its id is the SHA-256 of its canonical JSON.  Publication makes a new snapshot, if the
revision it was written against is still current.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import heapq
import json
import re
import threading
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, is_dataclass, replace  # noqa: F401 - replace is for users of these records
from functools import cached_property

from pyspark.sql import types as T

from marlstone.plans.errors import CompileError

NAME = re.compile(r"[a-z_][a-z0-9_]*")


@dataclass(frozen=True)
class Filter:
    """``field operator value`` with a typed literal (``{"type": ..., "value": ...}``)."""

    field: str
    operator: str
    value: Mapping


@dataclass(frozen=True)
class FieldMeaning:
    unit: str | None = None
    comparison: str = "binary"
    enum_domain: str | None = None
    reference_system: str | None = None
    calendar: str | None = None
    is_time: bool = False


@dataclass(frozen=True)
class Metric:
    id: str
    function: str
    field: str | None = None
    distinct: bool = False
    aliases: tuple[str, ...] = ()
    dimensions: frozenset[str] = frozenset()
    lookup_dimensions: frozenset[tuple[str, str]] = frozenset()
    rollup: frozenset[str] | None = None
    #: ("sum_count_average",), ("weighted_average", value, weight, zero), ("exact_distinct", field), ("snapshot_balance", value, time, tie)
    state: tuple | None = None
    filters: tuple[Filter, ...] = ()
    unit: str | None = None
    grain: str | None = None
    #: (field, unit, start, end): must be asked through one calendar filter on the field, inside the coverage
    temporal: tuple | None = None


@dataclass(frozen=True)
class Ratio:
    id: str
    numerator: str
    denominator: str
    zero: str = "null"
    aliases: tuple[str, ...] = ()
    unit: str | None = None


@dataclass(frozen=True)
class Concept:
    """A named predicate; ``{"parameter": name, "type": ...}`` in place of a literal is filled in by the query."""

    id: str
    predicate: Mapping
    aliases: tuple[str, ...] = ()
    parameters: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Relationship:
    id: str
    right: str
    role: str
    keys: tuple[tuple[str, str], ...]
    null_keys_match: bool = False
    #: (valid_from, valid_to) fields of the right side, half-open
    interval: tuple[str, str] | None = None


@dataclass(frozen=True)
class Conversion:
    id: str
    field: str
    numerator: int
    denominator: int
    unit: str | None = None
    half_even: bool = False


@dataclass(frozen=True)
class Rates:
    """Dated currency rates in a relation with from/to currencies, a half-open validity and a rational rate."""

    id: str
    amount: str
    currency: str
    time: str
    relation: str
    source: str
    target: str
    target_currency: str
    valid_from: str
    valid_to: str
    numerator: str
    denominator: str


@dataclass(frozen=True)
class BusinessCalendar:
    id: str
    field: str
    relation: str
    date: str
    zone: str | None = None
    fiscal_year: str = "fiscal_year"
    fiscal_period: str = "fiscal_period"
    business_day: str = "business_day"


@dataclass(frozen=True)
class Allocation:
    id: str
    keys: tuple[tuple[str, str], ...]
    amount: str
    expected_count: str
    expected_weight: str
    bridge: str
    targets: tuple[str, ...]
    weight: str
    bridge_filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Meaning:
    fields: Mapping[str, FieldMeaning] = field(default_factory=dict)
    metrics: tuple[Metric, ...] = ()
    ratios: tuple[Ratio, ...] = ()
    concepts: tuple[Concept, ...] = ()
    #: mapping id -> (enum domain, phrase -> code)
    mappings: Mapping[str, tuple[str | None, Mapping[str, str]]] = field(default_factory=dict)
    policies: tuple[tuple[str, tuple[Filter, ...]], ...] = ()
    relationships: tuple[Relationship, ...] = ()
    conversions: tuple[Conversion, ...] = ()
    rates: tuple[Rates, ...] = ()
    calendars: tuple[BusinessCalendar, ...] = ()
    allocations: tuple[Allocation, ...] = ()
    grain: str | None = None
    #: of a view: (unit, start, end) it covers; ``()`` for a view that states none
    coverage: tuple | None = None
    keys: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class Relation:
    name: str
    schema: T.StructType
    kind: str = "base"
    sql: str | None = None
    dependencies: tuple[str, ...] = ()
    description: str = ""
    meaning: Meaning = field(default_factory=Meaning)


def _plain(x):
    if isinstance(x, T.DataType):
        return json.loads(x.json())
    if isinstance(x, dt.date):
        return x.isoformat()
    if is_dataclass(x):
        return {k: _plain(getattr(x, k)) for k in x.__dataclass_fields__}
    if isinstance(x, Mapping):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted(json.dumps(_plain(v), sort_keys=True) for v in x)
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x


@dataclass(frozen=True)
class Snapshot:
    relations: Mapping[str, Relation] = field(default_factory=dict)
    revision: int = 0

    @cached_property
    def id(self) -> str:
        return hashlib.sha256(json.dumps({k: _plain(r) for k, r in self.relations.items()}, sort_keys=True).encode()).hexdigest()

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise CompileError("unknown_relation", name)
        return self.relations[name]


class Catalog:
    """The current snapshot, replaced as a whole."""

    def __init__(self):
        self.current = Snapshot()
        self.lock = threading.Lock()
        self._indexed: Snapshot | None = None
        self._parts: dict[str, Relation] = {}
        self._tables: tuple[dict, dict, dict] = ({}, {}, {})

    def publish(self, relations: list[Relation], expected_revision: int | None = None) -> Snapshot:
        """Add or replace relations at once; views must not depend on what isn't there, nor on themselves.  One publication at a time."""
        with self.lock:
            return self._publish(relations, expected_revision)

    def _publish(self, relations: list[Relation], expected_revision: int | None) -> Snapshot:
        if expected_revision is not None and expected_revision != self.current.revision:
            raise CompileError("revision_conflict", f"{self.current.revision} is current")
        merged = dict(self.current.relations)
        for r in relations:
            if not NAME.fullmatch(r.name):
                raise CompileError("invalid_scope", f"{r.name!r} is no relation name")
            merged[r.name] = r
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if state.get(name) == 1:
                raise CompileError("view_lineage", f"{name} depends on itself")
            if state.get(name) == 2:
                return
            state[name] = 1
            for d in merged[name].dependencies:
                if d not in merged:
                    raise CompileError("unknown_relation", d)
                visit(d)
            state[name] = 2

        for name in merged:
            visit(name)
        self.current = Snapshot(merged, self.current.revision + 1)
        return self.current

    def impact(self, name: str) -> list[str]:
        """Views that read a relation, directly or not."""
        found: set[str] = {name}
        grew = True
        while grew:
            new = {r.name for r in self.current.relations.values() if found & set(r.dependencies)} - found
            grew, found = bool(new), found | new
        return sorted(found - {name})

    def search(self, terms: str, limit: int = 64) -> list[tuple[str, str, float]]:
        """(kind, name, weight) of objects whose names, aliases or descriptions hold the terms; exact names first, ties by name.  Only objects that hold one are looked at."""
        weight: dict[tuple[str, str], float] = {}
        by_name, by_text, exact = self.words()
        for table, each in ((by_name, 2.0), (by_text, 1.0)):
            for w in set(re.findall(r"\w+", terms.lower())):
                for o in table.get(w, ()):
                    weight[o] = weight.get(o, 0.0) + each
        for o in exact.get(terms.lower(), ()):
            weight[o] = weight.get(o, 0.0) + 5.0
        return heapq.nsmallest(min(limit, 64), ((k, n, v) for (k, n), v in weight.items()), key=lambda h: (-h[2], h[0], h[1]))

    def words(self) -> tuple[dict, dict, dict]:
        """Objects by the words of their names, by those of their descriptions and aliases, and by whole names; relations that a publication leaves alone keep their part."""
        snapshot = self.current
        with self.lock:
            if self._indexed is not snapshot:
                for name in [n for n, r in self._parts.items() if snapshot.relations.get(n) is not r]:
                    for table, key, o in _entries(self._parts.pop(name)):
                        self._tables[table][key].discard(o)
                for name, r in snapshot.relations.items():
                    if name not in self._parts:
                        self._parts[name] = r
                        for table, key, o in _entries(r):
                            self._tables[table].setdefault(key, set()).add(o)
                self._indexed = snapshot
            return self._tables


def _entries(r: Relation) -> Iterator[tuple[int, str, tuple[str, str]]]:
    objects = [("relation", r.name, r.description), *(("field", f"{r.name}.{f.name}", "") for f in r.schema)]
    objects += [(k, f"{r.name}.{o.id}", " ".join(o.aliases)) for k, os_ in (("metric", r.meaning.metrics), ("ratio", r.meaning.ratios), ("concept", r.meaning.concepts)) for o in os_]
    for kind, name, text in objects:
        o = (kind, name)
        for w in set(re.findall(r"[a-z0-9]+", name.lower())):
            yield 0, w, o
        for w in set(re.findall(r"\w+", text.lower())):
            yield 1, w, o
        for whole in {name.lower(), name.split(".")[-1].lower()}:
            yield 2, whole, o
