"""Row queries: a strict JSON proposal is bound against a catalog snapshot and planned as one DataFrame.

The stages come in a fixed order: scan, row policies, then look-ups, existence tests and filters as they are asked
for, allocation, currency, business calendar, conversion, calendar grouping, aggregation, calendar fill, ratios, filters on outputs,
windows, filters on those, order, projection, page.  Columns are named by slot (a requirement's id) until the projection gives
them their aliases, so equal aliases upstream can't clash.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import exact
from marlstone.operators import allocation, calendar, joins
from marlstone.plans import catalog as C
from marlstone.plans.errors import CompileError
from marlstone.plans.literals import Predicates, take

AGGREGATE_KINDS = {"ratio", "group", "calendar_group", "aggregate", "metric", "allocate"}
INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
KEY = (*INTEGER, T.StringType, T.BooleanType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
ORDERED = (*INTEGER, T.DoubleType, T.StringType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
MAX_REQUIREMENTS, MAX_PAGE = 512, 1_000_000


@dataclass(frozen=True)
class Slot:
    """An output: its id, alias, type, unit, and what it is made of."""

    id: str
    alias: str
    type: T.DataType
    unit: str | None = None
    kind: str = "value"  # value, group, aggregate, window, ratio
    metric: C.Metric | None = None
    origin: str | None = None
    source: tuple[str, str] | None = None  # the relation and the field that a group's values are


@dataclass
class Bound:
    """A compiled query: the frame by slots, the slots in order, and the relations it reads.

    ``current`` tells whether the catalog is the one it was compiled against, ``restricted`` whether it was compiled for a scope.
    """

    frame: DataFrame
    slots: list[Slot]
    relations: set[str] = field(default_factory=set)
    current: Callable[[], bool] | None = None
    restricted: bool = False

    def authorised(self, allowed: set[str] | None) -> DataFrame:
        """The result, if the scope of whoever runs it now holds every relation read."""
        if self.current is not None and not self.current():
            raise CompileError("snapshot_mismatch", "the catalog has changed since")
        if allowed is None and self.restricted or allowed is not None and not self.relations <= allowed:
            raise CompileError("execution_scope", ", ".join(sorted(self.relations - (allowed or set()))))
        return self.named()

    def result(self) -> DataFrame:
        return self.authorised(None)

    def named(self) -> DataFrame:
        return self.frame.select(*(F.col(f"`{s.id}`").alias(s.alias) for s in self.slots))


def scalar_sum(c: Column, t: T.DataType, distinct: bool = False) -> tuple[Column, T.DataType]:
    if isinstance(t, INTEGER):
        return exact.checked_sum(c, distinct), T.LongType()
    if isinstance(t, T.DecimalType):
        return exact.decimal_sum(c, t.precision, t.scale, distinct), T.DecimalType(min(t.precision + 10, 38), t.scale)
    if isinstance(t, T.DoubleType):
        return (F.sum_distinct(c) if distinct else F.sum(c)), T.DoubleType()
    raise CompileError("aggregate_type", t.simpleString())


def aggregate(function: str, c: Column | None, t: T.DataType | None, distinct: bool = False) -> tuple[Column, T.DataType]:
    """Column and type of one aggregate."""
    if function == "count":
        if c is None:
            if distinct:
                raise CompileError("aggregate_arguments")
            return F.count(F.lit(1)), T.LongType()
        return (F.count_distinct(c) if distinct else F.count(c)), T.LongType()
    if c is None:
        raise CompileError("aggregate_arguments", function)
    if function == "sum":
        return scalar_sum(c, t, distinct)
    if function == "avg" and not distinct:
        if isinstance(t, INTEGER):
            return exact.exact_mean(c), T.DecimalType(38, 18)
        if isinstance(t, T.DoubleType):
            return F.avg(c), T.DoubleType()
    if function in ("min", "max") and isinstance(t, ORDERED):
        return (F.min if function == "min" else F.max)(c), t
    raise CompileError("aggregate_type", f"{function} of {t.simpleString()}")


class RowCompiler:
    """Compiles one query; ``table`` gives the DataFrame of a relation."""

    def __init__(self, snapshot: C.Snapshot, table: Callable[[str], DataFrame], allowed: set[str] | None = None, context: calendar.TimeContext | None = None, parameters: Mapping | None = None):
        self.snapshot, self.table, self.allowed, self.context, self.parameters = snapshot, table, allowed, context, parameters

    # -- scope -----------------------------------------------------------------------------------------------

    def open(self, name: str) -> C.Relation:
        r = self.snapshot.relation(name)
        if self.allowed is not None and name not in self.allowed:
            raise CompileError("access_scope", name)
        self.read.add(name)
        return r

    def scan(self, name: str, instance: str, filters: tuple[C.Filter, ...] = ()) -> DataFrame:
        """A relation under its policies, its fields named ``instance.field``."""
        r = self.open(name)
        frame = self.table(name)
        for f in (*(f for _, fs in r.meaning.policies for f in fs), *filters):
            frame = frame.where(self.governed(r, f, F.col(f"`{f.field}`")))
        return frame.select(*(F.col(f"`{f.name}`").alias(f"{instance}.{f.name}") for f in r.schema))

    def governed(self, r: C.Relation, f: C.Filter, column: Column) -> Column:
        if f.field not in r.schema.fieldNames():
            raise CompileError("policy_contract", f.field)
        return Predicates(lambda _: (column, r.schema[f.field].dataType, None)).column({"kind": "compare", "field": f.field, "operator": f.operator, "value": f.value})

    def field(self, ref) -> tuple[Column, T.DataType, C.FieldMeaning | None]:
        instance, name = take(ref, "instance", "field")
        if instance not in self.scope:
            raise CompileError("unknown_field", f"{instance}.{name}")
        r = self.scope[instance]
        if name not in r.schema.fieldNames():
            raise CompileError("unknown_field", f"{instance}.{name}")
        return F.col(f"`{instance}.{name}`"), r.schema[name].dataType, r.meaning.fields.get(name)

    def output(self, ref) -> tuple[Column, T.DataType, None]:
        name = take(ref, "slot")
        s = self.slots.get(name)
        if s is None:
            raise CompileError("unknown_output_slot", name)
        return F.col(f"`{s.id}`"), s.type, None

    def add(self, slot: Slot) -> None:
        if not slot.alias or any(s.alias == slot.alias for s in self.slots.values()):
            raise CompileError("invalid_output", slot.alias)
        self.slots[slot.id] = slot

    def relationship(self, name: str, role: str) -> C.Relationship:
        found = [x for x in self.relation.meaning.relationships if x.id == name]
        if not found:
            raise CompileError("unknown_relationship", name)
        x = found[0]
        if x.role != role or not x.keys:
            raise CompileError("relationship_contract", name)
        right = self.open(x.right)
        for a, b in x.keys:
            left_type = self.relation.schema[a].dataType if a in self.relation.schema.fieldNames() else None
            right_type = right.schema[b].dataType if b in right.schema.fieldNames() else None
            if left_type is None or left_type != right_type or not isinstance(left_type, KEY):
                raise CompileError("relationship_key_type", f"{a}, {b}")
            systems = [m.fields[f].reference_system for m, f in ((self.relation.meaning, a), (right.meaning, b)) if f in m.fields]
            if len(systems) == 2 and systems[0] != systems[1]:
                raise CompileError("relationship_reference_system", name)
        return x

    def new_instance(self, instance: str) -> str:
        if not instance or instance.startswith("$") or instance in self.scope:
            raise CompileError("invalid_scope", instance)
        return instance

    # -- compilation -----------------------------------------------------------------------------------------

    def compile(self, query: Mapping) -> Bound:
        version, source, requirements, unresolved = take(query, "version", "input", "requirements", "unresolved")
        if version != 1:
            raise CompileError("unsupported_version", str(version))
        if unresolved:
            raise CompileError("unresolved_terms", ", ".join(unresolved))
        if not requirements:
            raise CompileError("missing_requirements")
        if len(requirements) > MAX_REQUIREMENTS:
            raise CompileError("requirement_limit")
        name, self.instance = take(source, "relation", "instance")
        self.scope: dict[str, C.Relation] = {}
        self.slots: dict[str, Slot] = {}
        self.read: set[str] = set()
        self.new_instance(self.instance)
        self.relation = self.open(name)
        self.scope[self.instance] = self.relation
        self.ops = []
        seen = set()
        for r in requirements:
            rid, _, op = take(r, "id", "source_text", "operation")
            if not rid or rid in seen or not isinstance(op, Mapping) or "kind" not in op:
                raise CompileError("invalid_requirement", str(rid))
            seen.add(rid)
            if not hasattr(self, f"op_{op['kind']}"):
                raise CompileError("invalid_requirement", str(op["kind"]))
            self.ops.append((rid, op["kind"], op))
        kinds = [k for _, k, _ in self.ops]
        self.grouped = bool(AGGREGATE_KINDS & set(kinds)) or any(k == "lookup" and op.get("usage", "project") == "group" for _, k, op in self.ops)
        if "allocate" in kinds and len(kinds) > 1:
            raise CompileError("allocation_profile")
        self.coverage_rules(kinds)
        self.groups: list[tuple[Slot, Column]] = []
        self.measures: list[tuple[Slot, Column]] = []
        self.derived: list[tuple[Slot, Column]] = []
        self.frame = self.scan(name, self.instance)
        order = [
            ("concept_filter", "filter", "calendar_filter", "related", "lookup", "path_lookup"), ("allocate",), ("currency_convert",), ("business_calendar",), ("convert",),
            ("calendar_group", "group", "project"), ("aggregate", "metric", "ratio"),
        ]
        for stage in order:
            self.run(stage)
        if self.grouped and "allocate" not in kinds:
            keys = [c.alias(s.id) for s, c in self.groups]
            measures = [c.alias(s.id) for s, c in self.measures]
            if keys:
                self.frame = self.frame.groupBy(*keys).agg(*measures) if measures else self.frame.select(*keys).distinct()
            else:
                self.frame = self.frame.agg(*measures)
            self.run(("calendar_fill",))
            for s, c in self.derived:
                self.frame = self.frame.withColumn(s.id, c)
        self.stage = "after_aggregate"
        self.run(("filter_output",))
        self.run(("window",))
        self.stage = "after_window"
        self.run(("filter_output",))
        self.sorting: list[Column] = []
        self.run(("order", "order_output"))
        if not self.slots:
            raise CompileError("missing_projection")
        if self.sorting:
            self.frame = self.frame.orderBy(*self.sorting)
        pages = [k for k in kinds if k in ("limit", "page")]
        if len(pages) > 1:
            raise CompileError("conflicting_limits")
        self.run(("limit", "page"))
        slots = [self.slots[r] for rid, *_ in self.ops for r in self.slots if r == rid or r.startswith(f"{rid}#")]
        return Bound(self.frame.select(*(F.col(f"`{s.id}`") for s in slots)), slots, self.read)

    def run(self, kinds: tuple[str, ...]) -> None:
        for rid, kind, op in self.ops:
            if kind in kinds:
                try:
                    getattr(self, f"op_{kind}")(rid, {k: v for k, v in op.items() if k != "kind"})
                except CompileError as e:
                    raise e if e.requirement else CompileError(e.code, str(e), rid) from None

    def coverage_rules(self, kinds: list[str]) -> None:
        cover = self.relation.meaning.coverage
        if cover is None:
            return
        filters = [op for _, k, op in self.ops if k == "calendar_filter"]
        if not cover:
            if filters:
                raise CompileError("view_coverage_unproven")
            return
        unit, start, end = cover
        if len(filters) != 1:
            raise CompileError("view_coverage_unproven")
        low, high = self.bounds(filters[0]["period"])
        finer = ("day", "month", "year")
        if low < start or high > end or (unit in finer and filters[0]["period"]["unit"] in finer and finer.index(filters[0]["period"]["unit"]) < finer.index(unit)):
            raise CompileError("view_applicability")

    def bounds(self, period: Mapping) -> tuple[dt.date, dt.date]:
        unit, offset, count = take(period, "unit", "offset", "count")
        return calendar.interval(self.context, unit, offset, count)

    # -- row stage -------------------------------------------------------------------------------------------

    def predicates(self) -> Predicates:
        return Predicates(self.field, self.relation.meaning.mappings, self.parameters)

    def op_filter(self, rid: str, op: Mapping) -> None:
        self.frame = self.frame.where(self.predicates().column(take(op, "predicate")))

    def op_concept_filter(self, rid: str, op: Mapping) -> None:
        name, arguments = take(op, "concept", arguments={})
        found = [c for c in self.relation.meaning.concepts if c.id == name] or [c for c in self.relation.meaning.concepts if name in c.aliases]
        if not found:
            raise CompileError("unknown_concept", name)
        if len(found) > 1:
            raise CompileError("ambiguous_concept", name)
        concept = found[0]
        if set(arguments) - set(concept.parameters):
            raise CompileError("parameter_extra")
        if set(concept.parameters) - set(arguments):
            raise CompileError("parameter_missing")
        if any(arguments[k].get("type") != t for k, t in concept.parameters.items()):
            raise CompileError("parameter_contract")

        def fill(x):
            if isinstance(x, Mapping):
                if set(x) == {"parameter", "type"}:
                    return arguments[x["parameter"]]
                out = {k: fill(v) for k, v in x.items()}
                if isinstance(x.get("field"), str):
                    out["field"] = {"instance": self.instance, "field": x["field"]}
                return out
            return [fill(v) for v in x] if isinstance(x, (list, tuple)) else x

        self.frame = self.frame.where(self.predicates().column(fill(concept.predicate)))

    def op_calendar_filter(self, rid: str, op: Mapping) -> None:
        ref, period = take(op, "field", "period")
        column, kind, _ = self.field(ref)
        low, high = self.bounds(period)
        if isinstance(kind, T.DateType):
            self.frame = self.frame.where((column >= F.lit(low)) & (column < F.lit(high)))
        elif isinstance(kind, T.TimestampType):
            a, b = (int(calendar.midnight(d, self.context.zone).timestamp()) * 10**6 for d in (low, high))
            at = lambda us: F.timestamp_micros(F.lit(us).cast("bigint"))
            self.frame = self.frame.where((column >= at(a)) & (column < at(b)))
        else:
            raise CompileError("temporal_field_type", kind.simpleString())

    def op_related(self, rid: str, op: Mapping) -> None:
        name, role, instance, mode, predicate = take(op, "relationship", "role", "instance", "mode", predicate=None)
        x = self.relationship(name, role)
        self.new_instance(instance)
        right = self.scan(x.right, instance)
        if predicate is not None:
            outer, self.scope = self.scope, {instance: self.snapshot.relation(x.right)}
            right = right.where(Predicates(self.field, self.snapshot.relation(x.right).meaning.mappings, self.parameters).column(predicate))
            self.scope = outer
        keys = [(f"{self.instance}.{a}", f"{instance}.{b}") for a, b in x.keys]
        # names with dots are awkward in join conditions, so keys get plain ones
        right = right.select(*(F.col(f"`{b}`").alias(f"__r{i}") for i, (_, b) in enumerate(keys)))
        left = self.frame.withColumns({f"__l{i}": F.col(f"`{a}`") for i, (a, _) in enumerate(keys)})
        out = joins.related(left, right, [(f"__l{i}", f"__r{i}") for i in range(len(keys))], mode == "absent", x.null_keys_match)
        self.frame = out.drop(*(f"__l{i}" for i in range(len(keys))))

    def op_lookup(self, rid: str, op: Mapping) -> None:
        name, role, instance, value, alias, missing, usage = take(op, "relationship", "role", "instance", "field", "alias", "missing", usage="project")
        if self.grouped and usage != "group":
            raise CompileError("lookup_grain")
        x = self.relationship(name, role)
        slot = self.look_up(rid, self.instance, x, self.new_instance(instance), value, missing)
        slot = Slot(slot.id, alias, slot.type, kind="group" if usage == "group" else "value", origin=f"{name}.{value}", source=(x.right, value))
        self.add(slot)
        if usage == "group":
            if not isinstance(slot.type, KEY):
                raise CompileError("invalid_output", alias)
            self.groups.append((slot, F.col(f"`{rid}`")))

    def look_up(self, rid: str, left: str, x: C.Relationship, instance: str, value: str, missing: str) -> Slot:
        right = self.snapshot.relation(x.right)
        if value not in right.schema.fieldNames() or not isinstance(right.schema[value].dataType, ORDERED):
            raise CompileError("unknown_field" if value not in right.schema.fieldNames() else "aggregate_type", value)
        # names with dots are awkward in join conditions, so sides get plain ones
        side = self.scan(x.right, instance)
        side = side.select(*(F.col(f"`{instance}.{b}`").alias(f"__rk{i}") for i, (_, b) in enumerate(x.keys)), F.col(f"`{instance}.{value}`").alias("__rv"))
        frame = self.frame.withColumns({f"__lk{i}": F.col(f"`{left}.{a}`") for i, (a, _) in enumerate(x.keys)})
        plain = {c: f"__c{n}" for n, c in enumerate(frame.columns)}
        flat = frame.toDF(*plain.values())
        out = joins.lookup(flat, side, [(plain[f"__lk{i}"], f"__rk{i}") for i in range(len(x.keys))], "__rv", "__value", missing, x.null_keys_match)
        back = [F.col(p).alias(c) for c, p in plain.items() if not c.startswith("__lk")]
        self.frame = out.select(*back, F.col("__value").alias(rid))
        return Slot(rid, rid, right.schema[value].dataType)

    def op_path_lookup(self, rid: str, op: Mapping) -> None:
        hops, value, alias, missing = take(op, "hops", "field", "alias", "missing")
        if self.grouped:
            raise CompileError("path_lookup_grain")
        if len(hops) not in (1, 2):
            raise CompileError("path_lookup_limit")
        outer, left = self.relation, self.instance
        for n, hop in enumerate(hops):
            name, role, instance, as_of = take(hop, "relationship", "role", "instance", as_of=None)
            x = self.relationship(name, role)
            self.new_instance(instance)
            right = self.snapshot.relation(x.right)
            last = n == len(hops) - 1
            if as_of is not None:
                fact, low, high, zone = take(as_of, "fact_time", "valid_from", "valid_to", timezone=None)
                if zone not in (None, "UTC") or x.interval not in (None, (low, high)):
                    raise CompileError("path_lookup_contract")
                kinds = {self.relation.schema[fact].dataType.simpleString(), right.schema[low].dataType.simpleString(), right.schema[high].dataType.simpleString()}
                if len(kinds) != 1:
                    raise CompileError("path_lookup_key_type")
                wanted = [value] if last else [f.name for f in right.schema]
                side = self.scan(x.right, instance)
                side = side.toDF(*(c.replace(".", "__") for c in side.columns))
                plain = {c: f"__c{k}" for k, c in enumerate(self.frame.columns)}
                flat = self.frame.toDF(*plain.values())
                out = joins.as_of(flat, side, [(plain[f"{left}.{a}"], f"{instance}__{b}") for a, b in x.keys], plain[f"{left}.{fact}"], f"{instance}__{low}", f"{instance}__{high}", {f"__w{k}": f"{instance}__{w}" for k, w in enumerate(wanted)}, missing)
                self.frame = out.select(*(F.col(p).alias(c) for c, p in plain.items()), *(F.col(f"__w{k}").alias(rid if last else f"{instance}.{w}") for k, w in enumerate(wanted)))
            elif last:
                self.look_up(rid, left, x, instance, value, missing)
            else:
                # the next hop's keys come through this one, each with its own check
                following = take(hops[n + 1], "relationship", "role", "instance", as_of=None)
                nxt = next((r for r in right.meaning.relationships if r.id == following[0]), None)
                if nxt is None:
                    raise CompileError("path_lookup_contract", following[0])
                needed = [a for a, _ in nxt.keys] + ([following[3]["fact_time"]] if following[3] else [])
                for key in dict.fromkeys(needed):
                    self.look_up(f"{instance}.{key}", left, x, f"{instance}${key}", key, missing)
            self.scope[instance] = right
            self.relation, left = right, instance
        kind = self.relation.schema[value].dataType if value in self.relation.schema.fieldNames() else None
        self.relation = outer
        if kind is None:
            raise CompileError("unknown_field", value)
        self.add(Slot(rid, alias, kind))

    # -- values ----------------------------------------------------------------------------------------------

    def pick(self, items, name: str, code: str):
        found = [x for x in items if x.id == name]
        if not found:
            raise CompileError(f"unknown_{code}", name)
        return found[0]

    def op_allocate(self, rid: str, op: Mapping) -> None:
        name, aliases, amount_alias = take(op, "allocation", "target_aliases", "amount_alias")
        a = self.pick(self.relation.meaning.allocations, name, "allocation")
        if not 1 <= len(aliases) <= 2 or len(aliases) != len(a.targets):
            raise CompileError("allocation_profile")
        if not 1 <= len(a.keys) <= 4:
            raise CompileError("allocation_contract")
        left = self.frame.toDF(*(c.split(".", 1)[1] for c in self.frame.columns))
        right = self.scan(a.bridge, "bridge", a.bridge_filters)
        right = right.toDF(*(c.split(".", 1)[1] for c in right.columns))
        shares = allocation.allocate(left, right, list(a.keys), a.amount, a.expected_count, a.expected_weight, list(a.targets), a.weight)
        total, kind = scalar_sum(F.col("share"), T.LongType())
        self.frame = shares.groupBy(*(F.col(t).alias(f"{rid}#{i}") for i, t in enumerate(a.targets))).agg(total.alias(f"{rid}#amount"))
        bridge = self.snapshot.relation(a.bridge)
        for i, (t, alias) in enumerate(zip(a.targets, aliases)):
            self.add(Slot(f"{rid}#{i}", alias, bridge.schema[t].dataType, kind="group"))
        self.add(Slot(f"{rid}#amount", amount_alias, kind, kind="aggregate"))

    def op_convert(self, rid: str, op: Mapping) -> None:
        name, alias = take(op, "conversion", "alias")
        if self.grouped:
            raise CompileError("conversion_grain")
        c = self.pick(self.relation.meaning.conversions, name, "conversion")
        column, kind, _ = self.field({"instance": self.instance, "field": c.field})
        if not isinstance(kind, T.LongType):
            raise CompileError("conversion_type", c.field)
        self.frame = self.frame.withColumn(rid, exact.scale(column, c.numerator, c.denominator, c.half_even))
        self.add(Slot(rid, alias, T.DecimalType(38, 18), c.unit))

    def op_currency_convert(self, rid: str, op: Mapping) -> None:
        name, alias = take(op, "rate", "alias")
        if self.grouped:
            raise CompileError("currency_rate_profile")
        x = self.pick(self.relation.meaning.rates, name, "currency_rate")
        side = self.scan(x.relation, "rates").where(F.col(f"`rates.{x.target}`") == x.target_currency)
        side = side.toDF(*(c.replace(".", "__") for c in side.columns))
        plain = {c: f"__c{k}" for k, c in enumerate(self.frame.columns)}
        flat = self.frame.toDF(*plain.values())
        own = lambda f: plain[f"{self.instance}.{f}"]
        out = joins.as_of(flat, side, [(own(x.currency), f"rates__{x.source}")], own(x.time), f"rates__{x.valid_from}", f"rates__{x.valid_to}", {"__n": f"rates__{x.numerator}", "__d": f"rates__{x.denominator}"}, exactly_one=True)
        value = exact.scale_by(F.col(own(x.amount)), F.col("__n"), F.col("__d"))
        self.frame = out.select(*(F.col(p).alias(c) for c, p in plain.items()), value.alias(rid))
        self.add(Slot(rid, alias, T.DecimalType(38, 18), x.target_currency))

    def op_business_calendar(self, rid: str, op: Mapping) -> None:
        name, what, alias = take(op, "calendar", "field", "alias")
        if self.grouped:
            raise CompileError("business_calendar_profile")
        x = self.pick(self.relation.meaning.calendars, name, "business_calendar")
        value = {"fiscal_year": x.fiscal_year, "fiscal_period": x.fiscal_period, "business_day": x.business_day}.get(what)
        column, kind, _ = self.field({"instance": self.instance, "field": x.field})
        if value is None or not (isinstance(kind, T.DateType) and x.zone is None or isinstance(kind, T.TimestampType) and x.zone):
            raise CompileError("business_calendar_contract", name)
        side = self.scan(x.relation, "calendar")
        side = side.toDF(*(c.replace(".", "__") for c in side.columns))
        plain = {c: f"__c{k}" for k, c in enumerate(self.frame.columns)}
        flat = self.frame.toDF(*plain.values())
        day = F.col(plain[f"{self.instance}.{x.field}"])
        out = joins.exactly_one(flat, side, (exact.local_date(day, x.zone) if x.zone else day, f"calendar__{x.date}"), {"__value": f"calendar__{value}"})
        self.frame = out.select(*(F.col(p).alias(c) for c, p in plain.items()), F.col("__value").alias(rid))
        self.add(Slot(rid, alias, self.snapshot.relation(x.relation).schema[value].dataType))

    def op_project(self, rid: str, op: Mapping) -> None:
        ref, alias = take(op, "field", "alias")
        if self.grouped:
            raise CompileError("aggregate_grain", alias)
        column, kind, meaning = self.field(ref)
        self.frame = self.frame.withColumn(rid, column)
        self.add(Slot(rid, alias, kind, meaning.unit if meaning else None))

    # -- aggregation -----------------------------------------------------------------------------------------

    def op_group(self, rid: str, op: Mapping) -> None:
        ref, alias = take(op, "field", "alias")
        column, kind, meaning = self.field(ref)
        if not isinstance(kind, KEY):
            raise CompileError("invalid_output", alias)
        slot = Slot(rid, alias, kind, meaning.unit if meaning else None, "group", origin=ref["field"], source=(self.scope[ref["instance"]].name, ref["field"]))
        self.add(slot)
        self.groups.append((slot, column))

    def op_calendar_group(self, rid: str, op: Mapping) -> None:
        ref, grain, zone, alias = take(op, "field", "grain", "timezone", "alias")
        column, kind, _ = self.field(ref)
        if grain != "month" or zone != "UTC":
            raise CompileError("calendar_group_profile")
        if not isinstance(kind, T.TimestampType):
            raise CompileError("calendar_group_type")
        slot = Slot(rid, alias, T.TimestampType(), kind="group", origin=ref["field"])
        self.add(slot)
        self.groups.append((slot, exact.utc_month(column)))

    def op_aggregate(self, rid: str, op: Mapping) -> None:
        function, distinct, alias, ref = take(op, "function", "distinct", "alias", field=None)
        column, kind, meaning = self.field(ref) if ref is not None else (None, None, None)
        made, t = aggregate(function, column, kind, distinct)
        unit = meaning.unit if meaning and function in ("sum", "avg", "min", "max") else None
        slot = Slot(rid, alias, t, unit, "aggregate", origin=function)
        self.add(slot)
        self.measures.append((slot, made))

    def op_metric(self, rid: str, op: Mapping) -> None:
        name, alias, applicability = take(op, "name", "alias", applicability=None)
        ratios = [r for r in self.relation.meaning.ratios if r.id == name or name in r.aliases]
        if ratios:
            r = ratios[0]
            parts = [self.metric(x, {}) for x in (r.numerator, r.denominator)]
            self.ratio_slot(rid, alias, [(c, t) for c, t, _ in parts], r.zero, r.unit)
            return
        column, t, m = self.metric(name, applicability or {})
        slot = Slot(rid, alias, t, m.unit, "aggregate", m)
        self.add(slot)
        self.measures.append((slot, column))

    def metric(self, name: str, applicability: Mapping) -> tuple[Column, T.DataType, C.Metric]:
        every = self.relation.meaning.metrics
        found = [m for m in every if m.id == name] or [m for m in every if name in m.aliases]
        unit, grain = take(applicability, required_unit=None, required_source_grain=None)
        fit = [m for m in found if (unit is None or m.unit == unit) and (grain is None or m.grain == grain)]
        if not found:
            raise CompileError("unknown_metric", name)
        if not fit:
            raise CompileError("metric_applicability" if len(found) > 1 else "metric_unit" if unit is not None and found[0].unit != unit else "metric_grain", name)
        if len(fit) > 1:
            raise CompileError("ambiguous_metric", name)
        m = fit[0]
        for _, kind, op in self.ops:
            if kind in ("group", "calendar_group") and op["field"]["field"] not in m.dimensions:
                raise CompileError("metric_dimensions", op["field"]["field"])
            if kind == "lookup" and (op["relationship"], op["field"]) not in m.lookup_dimensions:
                raise CompileError("metric_dimensions", op["field"])
        if m.temporal:
            name_, unit_, start, end = m.temporal
            filters = [op for _, k, op in self.ops if k == "calendar_filter"]
            if len(filters) != 1 or filters[0]["field"]["field"] != name_ or filters[0]["period"]["unit"] != unit_:
                raise CompileError("metric_time_grain")
            low, high = self.bounds(filters[0]["period"])
            if low < start or high > end:
                raise CompileError("metric_coverage")
        keep = None
        for f in m.filters:
            c = self.governed(self.relation, f, F.col(f"`{self.instance}.{f.field}`"))
            keep = c if keep is None else keep & c
        col = lambda f: self.field({"instance": self.instance, "field": f})
        only = lambda c: c if keep is None else F.when(keep, c)
        if m.state and m.state[0] == "weighted_average":
            _, value, weight, zero = m.state
            return exact.weighted_mean(only(col(value)[0]), only(col(weight)[0]), zero), T.DecimalType(38, 18), m
        if m.state and m.state[0] == "exact_distinct":
            return exact.exact_distinct(only(col(m.state[1])[0])), T.LongType(), m
        if m.state and m.state[0] == "sum_count_average":
            return exact.exact_mean(only(col(m.field)[0])), T.DecimalType(38, 18), m
        if m.state and m.state[0] == "snapshot_balance":
            if keep is not None:
                raise CompileError("unsupported_metric_state", m.id)
            _, value, time, tie = m.state
            return exact.snapshot_balance(col(value)[0], col(time)[0], col(tie)[0]), T.LongType(), m
        if m.state:
            raise CompileError("unsupported_metric_state", m.id)
        if m.field is None:
            return (F.count(F.lit(1)) if keep is None else F.count(F.when(keep, F.lit(1)))), T.LongType(), m
        column, t, _ = col(m.field)
        return (*aggregate(m.function, only(column), t, m.distinct), m)

    def op_ratio(self, rid: str, op: Mapping) -> None:
        numerator, denominator, zero, alias = take(op, "numerator", "denominator", "zero", "alias")
        parts = []
        for side in (numerator, denominator):
            function, distinct, ref = take(side, "function", "distinct", field=None)
            column, kind, _ = self.field(ref) if ref is not None else (None, None, None)
            parts.append(aggregate(function, column, kind, distinct))
        self.ratio_slot(rid, alias, parts, zero, None)

    def ratio_slot(self, rid: str, alias: str, parts: list[tuple[Column, T.DataType]], zero: str, unit: str | None) -> None:
        if any(not isinstance(t, T.LongType) for _, t in parts):
            raise CompileError("ratio_type")
        for n, (c, t) in enumerate(parts):
            self.measures.append((Slot(f"{rid}$part{n}", "", t), c))
        slot = Slot(rid, alias, T.DecimalType(38, 18), unit, "ratio")
        self.add(slot)
        self.derived.append((slot, exact.ratio(F.col(f"`{rid}$part0`"), F.col(f"`{rid}$part1`"), zero)))

    def op_calendar_fill(self, rid: str, op: Mapping) -> None:
        month, count, start, end, fill = take(op, "month_slot", "count_slot", "start_us", "end_us", fill=0)
        kinds = [k for _, k, _ in self.ops]
        plain = [o for _, k, o in self.ops if k == "aggregate"]
        if kinds.count("calendar_group") != 1 or len(plain) != 1 or plain[0]["function"] != "count" or plain[0].get("field") is not None or fill != 0 or set(kinds) - {"calendar_group", "aggregate", "calendar_fill", "filter", "concept_filter", "calendar_filter", "order_output", "limit", "page"}:
            raise CompileError("calendar_fill_profile")
        at = lambda us: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
        self.frame = calendar.calendar_fill(self.frame, month, count, at(start), at(end))

    # -- outputs ---------------------------------------------------------------------------------------------

    def op_filter_output(self, rid: str, op: Mapping) -> None:
        stage, predicate = take(op, "stage", "predicate")
        if stage not in ("after_aggregate", "after_window"):
            raise CompileError("filter_stage", stage)
        if stage == self.stage:
            if stage == "after_aggregate" and not self.grouped:
                raise CompileError("output_filter_scope")
            self.frame = self.frame.where(Predicates(self.output).column(predicate))

    def window_input(self, x: Mapping) -> tuple[Column, T.DataType, Slot | None]:
        if x.get("kind") == "field":
            if self.grouped:
                raise CompileError("window_grain")
            c, t, _ = self.field(take(x, "kind", "field")[1])
            return c, t, None
        slot = take(x, "kind", "slot")[1]
        if not self.grouped:
            raise CompileError("window_grain")
        if slot in self.slots and self.slots[slot].kind == "window":
            raise CompileError("window_scope")
        c, t, _ = self.output({"slot": slot})
        return c, t, self.slots[slot]

    def op_window(self, rid: str, op: Mapping) -> None:
        spec, alias = take(op, "window", "alias") if "window" in op else ({k: v for k, v in op.items() if k != "alias"}, op.get("alias"))
        function, partition, order, frame, value = take(spec, "function", "partition_by", "order_by", "frame", input=None)
        keys = [self.window_input(p) for p in partition]
        if any(not isinstance(t, KEY) for _, t, _ in keys):
            raise CompileError("window_key_type")
        by = []
        for o in order:
            x, direction, nulls = take(o, "input", "direction", "nulls")
            c, t, s = self.window_input(x)
            if not isinstance(t, KEY):
                raise CompileError("window_key_type")
            by.append((sort_key(c, direction, nulls), s))
        if not by and (function in ("rank", "dense_rank") or frame != "entire_partition"):
            raise CompileError("window_order")
        w = Window.partitionBy(*(c for c, *_ in keys)).orderBy(*(c for c, _ in by)) if by else Window.partitionBy(*(c for c, *_ in keys))
        if function in ("rank", "dense_rank"):
            if value is not None or frame != "through_current_peer":
                raise CompileError("window_contract")
            if not keys:  # over all rows: ranks come from the counts of the ordering's values, so that rows stay where they are
                self.frame = whole_rank(self.frame, rid, function, [(self.window_input(o["input"])[0], o["direction"], o["nulls"]) for o in order])
                self.add(Slot(rid, alias, T.LongType(), kind="window"))
                return
            made, t = (F.rank() if function == "rank" else F.dense_rank()).over(w).cast("bigint"), T.LongType()
        else:
            c, kind, slot = self.window_input(value) if value is not None else (None, None, None)
            if frame == "rows_through_current":
                covered = {s.id for _, _, s in keys if s} | {s.id for _, s in by if s}
                if function != "sum" or slot is None or slot.kind != "aggregate":
                    raise CompileError("cumulative_frame")
                if {s.id for s, _ in self.groups} - covered:
                    raise CompileError("cumulative_order")
            if function == "sum" and slot is not None:
                if slot.kind == "ratio" or slot.origin not in ("sum", "count") and slot.metric is None:
                    raise CompileError("metric_rollup")
                if slot.metric is not None and (slot.metric.rollup is None or slot.metric.distinct or {s.origin for s, _ in self.groups} - {s.origin for _, _, s in keys if s} - slot.metric.rollup):
                    raise CompileError("metric_rollup")
            edges = {"entire_partition": (True, Window.unboundedFollowing), "through_current_peer": (False, Window.currentRow), "rows_through_current": (True, Window.currentRow)}
            rows, end = edges[frame]
            w = w.rowsBetween(Window.unboundedPreceding, end) if rows else w.rangeBetween(Window.unboundedPreceding, end)
            made, t = windowed(function, c, kind, w)
        slot = Slot(rid, alias, t, kind="window")
        self.frame = self.frame.withColumn(rid, made)
        self.add(slot)

    def op_order(self, rid: str, op: Mapping) -> None:
        ref, direction, nulls = take(op, "field", "direction", "nulls")
        if self.grouped:
            raise CompileError("aggregate_order")
        column, kind, _ = self.field(ref)
        if not isinstance(kind, ORDERED):
            raise CompileError("unsupported_order_type", kind.simpleString())
        self.sorting.append(sort_key(column, direction, nulls))

    def op_order_output(self, rid: str, op: Mapping) -> None:
        slot, direction, nulls = take(op, "slot", "direction", "nulls")
        self.sorting.append(sort_key(self.output({"slot": slot})[0], direction, nulls))

    def op_limit(self, rid: str, op: Mapping) -> None:
        self.frame = self.frame.limit(take(op, "count"))

    def op_page(self, rid: str, op: Mapping) -> None:
        offset, fetch = take(op, "offset", "fetch")
        if not 0 <= offset <= MAX_PAGE or not 0 <= fetch <= MAX_PAGE:
            raise CompileError("page_limit")
        self.frame = self.frame.offset(offset).limit(fetch)


def whole_rank(frame: DataFrame, name: str, function: str, order: list[tuple[Column, str, str]]) -> DataFrame:
    """Ranks over all rows as ``name``: from the counts of the ordering's different values, which alone are brought together."""
    names = [f"__o{i}" for i in range(len(order))]
    made = frame.withColumns({n: c for n, (c, *_) in zip(names, order)})
    weight = F.count(F.lit(1)) if function == "rank" else F.max(F.lit(1))
    before = Window.orderBy(*(sort_key(F.col(n), d, z) for n, (_, d, z) in zip(names, order))).rowsBetween(Window.unboundedPreceding, -1)
    counted = made.groupBy(*names).agg(weight.cast("bigint").alias("__w"))
    ranked = counted.select(*(F.col(n).alias(f"{n}r") for n in names), (F.coalesce(F.sum("__w").over(before), F.lit(0)) + 1).cast("bigint").alias(name))
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}r"))
    return made.join(ranked, on).drop(*names, *(f"{n}r" for n in names))


def windowed(function: str, c: Column | None, kind: T.DataType | None, w) -> tuple[Column, T.DataType]:
    if function == "count":
        return F.count(F.lit(1) if c is None else c).over(w), T.LongType()
    if c is None:
        raise CompileError("aggregate_arguments", function)
    if function == "sum":
        if isinstance(kind, INTEGER):
            return F.sum(c.cast(exact.WIDE)).over(w).cast("bigint"), T.LongType()
        if isinstance(kind, T.DecimalType):
            t = T.DecimalType(min(kind.precision + 10, 38), kind.scale)
            return F.sum(c).over(w).cast(t), t
        if isinstance(kind, T.DoubleType):
            return F.sum(c).over(w), kind
    if function in ("min", "max") and isinstance(kind, ORDERED):
        return (F.min if function == "min" else F.max)(c).over(w), kind
    raise CompileError("aggregate_type", function)


def sort_key(c: Column, direction: str, nulls: str) -> Column:
    return {("asc", "first"): c.asc_nulls_first, ("asc", "last"): c.asc_nulls_last, ("desc", "first"): c.desc_nulls_first, ("desc", "last"): c.desc_nulls_last}[direction, nulls]()

