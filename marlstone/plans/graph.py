"""Query graphs: a DAG of row queries, set operations, compositions and calculations over their slots."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import exact
from marlstone.operators import joins
from marlstone.plans.errors import CompileError
from marlstone.plans.literals import OPERATORS, Predicates, literal, take
from marlstone.plans.rows import Bound, RowCompiler, Slot, sort_key

MAX_NODES, MAX_EXPANSION, MAX_GRAPH_DEPTH = 64, 512, 32
EXACT = (T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


class GraphCompiler:
    """Compiles a graph with the row compiler that ``rows`` makes."""

    def __init__(self, rows: Callable[[], RowCompiler]):
        self.rows = rows

    def compile(self, query: Mapping) -> Bound:
        version, nodes, root, ordering, unresolved, limit = take(query, "version", "nodes", "root", "ordering", "unresolved", limit=None)
        if version != 1:
            raise CompileError("unsupported_version", str(version))
        if unresolved:
            raise CompileError("unresolved_terms", ", ".join(unresolved))
        by: dict[str, Mapping] = {}
        for n in nodes:
            nid, _, op = take(n, "id", "source_text", "operation")
            if not nid or nid in by:
                raise CompileError("graph_identity", nid)
            by[nid] = op
        if root not in by:
            raise CompileError("graph_root", root)
        if len(by) > MAX_NODES:
            raise CompileError("graph_expansion_limit")
        size: dict[str, int] = {}

        def visit(nid: str, path: tuple[str, ...]) -> int:
            if nid in path:
                raise CompileError("graph_cycle", nid)
            if nid not in by:
                raise CompileError("graph_edge", nid)
            if len(path) > MAX_GRAPH_DEPTH:
                raise CompileError("graph_expansion_limit")
            if nid not in size:
                size[nid] = 1 + sum(visit(e, (*path, nid)) for e in self.edges(by[nid]))
            return size[nid]

        if visit(root, ()) > MAX_EXPANSION:
            raise CompileError("graph_expansion_limit")
        if set(by) - set(size):
            raise CompileError("graph_coverage", ", ".join(sorted(set(by) - set(size))))
        built: dict[str, Bound] = {}

        def build(nid: str) -> Bound:
            if nid not in built:
                op = by[nid]
                inputs = [build(e) for e in self.edges(op)]
                built[nid] = getattr(self, f"op_{op['kind']}")(op, *inputs)
            return built[nid]

        out = build(root)
        keys = []
        for o in ordering:
            slot, direction, nulls = take(o, "slot", "direction", "nulls")
            if slot not in {s.id for s in out.slots}:
                raise CompileError("graph_order", slot)
            keys.append(sort_key(F.col(f"`{slot}`"), direction, nulls))
        frame = out.frame.orderBy(*keys) if keys else out.frame
        return Bound(frame.limit(limit) if limit is not None else frame, out.slots, out.relations)

    def edges(self, op: Mapping) -> list[str]:
        kind = op.get("kind")
        if kind == "rows":
            return []
        if kind in ("set", "compose"):
            return [op.get("left"), op.get("right")]
        if kind in ("calculate", "conditional", "cast", "null_test", "compare_slots", "filter"):
            return [op.get("input")]
        raise CompileError("invalid_requirement", str(kind))

    def op_rows(self, op: Mapping) -> Bound:
        return self.rows().compile(take(op, "kind", "query")[1])

    def slot(self, b: Bound, sid: str) -> Slot:
        found = next((s for s in b.slots if s.id == sid), None)
        if found is None:
            raise CompileError("graph_slot", sid)
        return found

    def finish(self, frame, slots: list[Slot], *inputs: Bound) -> Bound:
        if not slots or len({s.id for s in slots}) != len(slots) or len({s.alias for s in slots}) != len(slots):
            raise CompileError("graph_output")
        return Bound(frame, slots, set().union(*(b.relations for b in inputs)))

    def op_set(self, op: Mapping, left: Bound, right: Bound) -> Bound:
        _, _, _, operator, duplicates, columns = take(op, "kind", "left", "right", "operator", "duplicates", "columns")
        if not columns:
            raise CompileError("graph_columns")
        slots, sides = [], ([], [])
        for c in columns:
            cid, l, r, alias = take(c, "id", "left", "right", "alias")
            a, b = self.slot(left, l), self.slot(right, r)
            if a.type != b.type:
                raise CompileError("set_type", f"{a.type.simpleString()}, {b.type.simpleString()}")
            if a.unit != b.unit:
                raise CompileError("set_unit")
            slots.append(Slot(cid, alias, a.type, a.unit))
            for side, s in zip(sides, (a, b)):
                side.append(F.col(f"`{s.id}`").alias(cid))
        return self.finish(joins.set_operation(left.frame.select(*sides[0]), right.frame.select(*sides[1]), operator, duplicates), slots, left, right)

    def op_compose(self, op: Mapping, left: Bound, right: Bound) -> Bound:
        _, _, _, owner, name, role, domain, nulls, keys, outputs = take(op, "kind", "left", "right", "relationship_relation", "relationship", "role", "domain", "null_alignment", "keys", "outputs")
        for b, side in ((left, "left"), (right, "right")):
            groups = {s.id for s in b.slots if s.kind == "group"}
            if groups != {k[side] for k in keys} or any(s.kind == "value" for s in b.slots):
                # facts are put side by side at one common grain, never multiplied
                raise CompileError("composition_grain", side)
        pairs = self.authored(owner, name, role, len(keys))
        slots, plain, made = [], [], []
        for k in keys:
            kid, l, r, alias = take(k, "id", "left", "right", "alias")
            a, b = self.slot(left, l), self.slot(right, r)
            if a.type != b.type:
                raise CompileError("composition_key_type", kid)
            if (a.source, b.source) not in pairs:
                # groups stand for the authored keys, each used once
                raise CompileError("composition_key_origin", kid)
            pairs.remove((a.source, b.source))
            slots.append(Slot(kid, alias, a.type, a.unit, "group", source=a.source))
            plain.append((a.id, b.id, kid))
        for o in outputs:
            oid, side, sid, alias, missing = take(o, "id", "side", "slot", "alias", "missing")
            s = self.slot(left if side == "left" else right, sid)
            if missing == "zero" and not isinstance(s.type, EXACT):
                raise CompileError("missing_group_type", oid)
            slots.append(Slot(oid, alias, s.type, s.unit, "aggregate", s.metric))
            made.append((side, s.id, oid, missing))
        frame = joins.compose(left.frame, right.frame, plain, made, domain, nulls == "match")
        return self.finish(frame, slots, left, right)

    def authored(self, owner: str, name: str, role: str, keys: int) -> list[tuple[tuple[str, str], tuple[str, str]]]:
        """The key pairs, as fields of relations, of the relationship that a composition by ``keys`` keys names; one without keys names none."""
        if not keys:
            if owner or name or role:
                raise CompileError("composition_relationship", "frames of one row have no relationship")
            return []
        compiler = self.rows()
        compiler.read = set()
        found = next((x for x in compiler.open(owner).meaning.relationships if x.id == name), None)
        if found is None:
            raise CompileError("unknown_relationship", name)
        if found.role != role or len(found.keys) != keys or compiler.allowed is not None and found.right not in compiler.allowed:
            raise CompileError("composition_relationship", name)
        return [((owner, a), (found.right, b)) for a, b in found.keys]

    def project(self, source: Bound, passthrough: list) -> tuple[list[Slot], list]:
        slots, cols = [], []
        for p in passthrough:
            pid, sid, alias = take(p, "id", "slot", "alias")
            s = self.slot(source, sid)
            slots.append(Slot(pid, alias, s.type, s.unit, s.kind, s.metric, s.origin, s.source))
            cols.append(F.col(f"`{s.id}`").alias(pid))
        return slots, cols

    def whole(self, source: Bound, sid: str, code: str) -> Slot:
        s = self.slot(source, sid)
        if not isinstance(s.type, T.LongType):
            raise CompileError(code, sid)
        return s

    def op_calculate(self, op: Mapping, source: Bound) -> Bound:
        _, _, passthrough, ratios = take(op, "kind", "input", "passthrough", "ratios")
        slots, cols = self.project(source, passthrough)
        for r in ratios:
            rid, n, d, zero, alias, unit = take(r, "id", "numerator", "denominator", "zero", "alias", required_unit=None)
            a, b = self.whole(source, n, "graph_ratio_type"), self.whole(source, d, "graph_ratio_type")
            made = None if a.unit == b.unit else a.unit if b.unit is None else f"{a.unit or 1}/{b.unit}"
            if unit is not None and unit != made:
                raise CompileError("graph_ratio_unit", rid)
            slots.append(Slot(rid, alias, T.DecimalType(38, 18), made, "ratio"))
            cols.append(exact.ratio(F.col(f"`{n}`"), F.col(f"`{d}`"), zero).alias(rid))
        return self.finish(source.frame.select(*cols), slots, source)

    def outputs_of(self, source: Bound) -> Predicates:
        def resolve(ref):
            s = self.slot(source, take(ref, "slot"))
            return F.col(f"`{s.id}`"), s.type, None

        return Predicates(resolve)

    def op_conditional(self, op: Mapping, source: Bound) -> Bound:
        _, _, passthrough, outputs = take(op, "kind", "input", "passthrough", "outputs")
        slots, cols = self.project(source, passthrough)
        for o in outputs:
            oid, alias, when, yes, no = take(o, "id", "alias", "when", "then_value", "else_value")
            (t, a), (u, b) = literal(yes), literal(no)
            if t != u:
                raise CompileError("graph_conditional_type", oid)
            slots.append(Slot(oid, alias, t))
            cols.append(F.when(self.outputs_of(source).column(when), a).otherwise(b).alias(oid))
        return self.finish(source.frame.select(*cols), slots, source)

    def op_cast(self, op: Mapping, source: Bound) -> Bound:
        _, _, passthrough, casts = take(op, "kind", "input", "passthrough", "casts")
        slots, cols = self.project(source, passthrough)
        for c in casts:
            cid, sid, target, alias = take(c, "id", "slot", "target", "alias")
            s = self.whole(source, sid, "graph_cast_type")
            if target != "decimal128_38_0":
                raise CompileError("graph_cast", target)
            slots.append(Slot(cid, alias, T.DecimalType(38, 0), s.unit))
            cols.append(F.col(f"`{s.id}`").cast(T.DecimalType(38, 0)).alias(cid))
        return self.finish(source.frame.select(*cols), slots, source)

    def op_null_test(self, op: Mapping, source: Bound) -> Bound:
        _, _, passthrough, tests = take(op, "kind", "input", "passthrough", "tests")
        slots, cols = self.project(source, passthrough)
        for t in tests:
            tid, sid, operator, alias = take(t, "id", "slot", "operator", "alias")
            c = F.col(f"`{self.whole(source, sid, 'graph_null_test_type').id}`")
            if operator not in ("is_null", "is_not_null"):
                raise CompileError("graph_null_test", operator)
            slots.append(Slot(tid, alias, T.BooleanType()))
            cols.append((c.isNull() if operator == "is_null" else c.isNotNull()).alias(tid))
        return self.finish(source.frame.select(*cols), slots, source)

    def op_compare_slots(self, op: Mapping, source: Bound) -> Bound:
        _, _, passthrough, comparisons = take(op, "kind", "input", "passthrough", "comparisons")
        slots, cols = self.project(source, passthrough)
        for c in comparisons:
            cid, l, r, operator, alias = take(c, "id", "left", "right", "operator", "alias")
            a, b = self.whole(source, l, "graph_comparison_type"), self.whole(source, r, "graph_comparison_type")
            if a.unit != b.unit:
                raise CompileError("graph_comparison_unit", cid)
            slots.append(Slot(cid, alias, T.BooleanType()))
            cols.append(OPERATORS[operator](F.col(f"`{a.id}`"), F.col(f"`{b.id}`")).alias(cid))
        return self.finish(source.frame.select(*cols), slots, source)

    def op_filter(self, op: Mapping, source: Bound) -> Bound:
        _, _, predicate = take(op, "kind", "input", "predicate")
        return self.finish(source.frame.where(self.outputs_of(source).column(predicate)), source.slots, source)
