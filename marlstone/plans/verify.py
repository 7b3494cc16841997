"""A second look at a compiled query before it is run: its analysed plan against what it was compiled to be."""

from __future__ import annotations

from marlstone.plans.errors import CompileError
from marlstone.plans.rows import Bound

#: Plan nodes that would leave the JVM or write (fixed values).
FOREIGN = {"MapInPandas", "MapInArrow", "PythonMapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "ArrowEvalPython", "BatchEvalPython", "MapPartitions", "MapElements", "InsertIntoHadoopFsRelationCommand"}


def verify(bound: Bound, snapshot) -> None:
    """Outputs in order and type, relations within those bound, no row limit that wasn't asked, and nothing but relational nodes above the relations."""
    from marlstone.session import seq

    result = bound.named()
    if [s.alias for s in bound.slots] != result.columns or len(set(result.columns)) != len(result.columns):
        raise CompileError("plan_output", ", ".join(result.columns))
    for s, f in zip(bound.slots, result.schema):
        if s.type != f.dataType:
            raise CompileError("plan_output", f"{s.alias}: {f.dataType.simpleString()}, declared {s.type.simpleString()}")
    expanded: set[str] = set()
    for n in bound.relations:
        stack = [n]
        while stack:
            expanded.add(name := stack.pop())
            stack += snapshot.relation(name).dependencies
    stack = [result._jdf.queryExecution().analyzed()]
    while stack:
        plan = stack.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "SubqueryAlias" and plan.identifier().name() in snapshot.relations:
            name = plan.identifier().name()
            if name not in expanded:
                raise CompileError("plan_relations", name)
            if name in bound.relations:
                continue  # what a relation is made of is its author's affair
        if kind in FOREIGN:
            raise CompileError("plan_shape", kind)
        stack += seq(plan.children())
