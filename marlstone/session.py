"""The engine: relations and views in a session of its own, read-only SQL, typed queries, parameters and budgets."""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.operators.calendar import TimeContext
from marlstone.plans import catalog as C
from marlstone.plans.errors import CompileError
from marlstone.plans.graph import GraphCompiler
from marlstone.plans.rows import Bound, RowCompiler
from marlstone.sources.generations import Generations, Outcome, Receipt

#: Logical plan nodes a read-only statement may consist of (fixed values).
READ_ONLY = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "Join", "LateralJoin",
    "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "WithWindowDefinition",
    "UnresolvedSubqueryColumnAliases", "Generate", "Pivot", "Unpivot", "UnresolvedTableValuedFunction", "Deduplicate", "Sample",
}
#: Built-in functions that read more than their arguments: code, files, the session, the layout of a task (fixed values).
REFUSED = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "spark_partition_id", "monotonically_increasing_id",
    "current_catalog", "current_database", "current_schema", "current_user", "session_user", "user", "version", "current_path", "raise_error", "assert_true",
}
#: Compiled proposals that an engine keeps.
COMPILED = 256
#: Functions that may stand for a relation, or make rows (fixed values).
GENERATORS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}


def seq(items) -> list:
    """A Scala sequence as a list."""
    out, it = [], items.iterator()
    while it.hasNext():
        out.append(it.next())
    return out


def expressions(plan) -> Iterator:
    """All expressions of a plan's own node, and theirs."""
    stack = seq(plan.expressions())
    while stack:
        e = stack.pop()
        yield e
        stack += seq(e.children())


def builtin(spark: SparkSession, name: str) -> bool:
    jvm = spark._jvm
    registry = getattr(getattr(jvm.org.apache.spark.sql.catalyst.analysis, "FunctionRegistry$"), "MODULE$").builtin()
    return bool(registry.functionExists(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)))


def check_functions(spark: SparkSession, plan) -> None:
    """Refuse functions that aren't built in, and those that reach beyond their arguments."""
    for e in expressions(plan):
        kind = e.getClass().getSimpleName()
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = seq(e.nameParts()) if kind == "UnresolvedFunction" else [e.name().funcName()]
            name = parts[-1].lower()
            if len(parts) > 1 or name in REFUSED or not (builtin(spark, name) if kind == "UnresolvedFunction" else name in GENERATORS):
                raise CompileError("read_only", f"function {'.'.join(parts)}")
    if plan.getClass().getSimpleName() == "UnresolvedTableValuedFunction" and ([n.lower() for n in seq(plan.name())] not in [[g] for g in GENERATORS]):
        raise CompileError("read_only", f"function {'.'.join(seq(plan.name()))}")


def plan_facts(spark: SparkSession, sql: str) -> tuple[set[str], list[list[str]]]:
    """Node names of a parsed statement and the names of the relations it reads, common table expressions left out; refuses functions by name."""
    return parsed_facts(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def parsed_facts(spark: SparkSession, parsed) -> tuple[set[str], list[list[str]]]:
    nodes: set[str] = set()
    relations: list[list[str]] = []

    def walk(plan, hidden: frozenset[str]) -> None:
        name = plan.getClass().getSimpleName()
        nodes.add(name)
        check_functions(spark, plan)
        if name == "UnresolvedWith":
            ctes = plan.cteRelations().iterator()
            while ctes.hasNext():
                c = ctes.next()
                walk(c._2(), hidden)
                hidden = hidden | {c._1().lower()}
        if name == "UnresolvedRelation":
            parts = plan.multipartIdentifier()
            found = [parts.apply(i) for i in range(parts.size())]
            if not (len(found) == 1 and found[0].lower() in hidden):
                relations.append(found)
        for e in expressions(plan):
            if hasattr(e, "plan") and e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                walk(e.plan(), hidden)
        kids = plan.children().iterator()
        while kids.hasNext():
            walk(kids.next(), hidden)

    walk(parsed, frozenset())
    return nodes, relations


class Engine:
    """A catalog bound to data.  One engine has one Spark session, with ANSI rules, UTC and no SQL over bare files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        for k, v in {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.runSQLOnFiles": "false"}.items():
            self.spark.conf.set(k, v)
        self.catalog = C.Catalog()
        self.lock = threading.Lock()
        self.plans: dict[tuple[int, str], DataFrame] = {}
        self.proposals: OrderedDict[tuple, Bound] = OrderedDict()
        self.unopened: dict[str, Callable[[], DataFrame]] = {}
        self.bindings: dict[str, Generations] = {}
        self.opening = threading.RLock()

    # -- relations -------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], meaning: C.Meaning | None = None, description: str = "", schema: T.StructType | None = None) -> C.Relation:
        """A base relation over a DataFrame, or over a function that gives one; with its ``schema`` told, the function isn't called before the relation is read."""
        if callable(df) and schema is None:
            df = df()
        relation = C.Relation(name, schema if callable(df) else df.schema, description=description, meaning=meaning or C.Meaning())
        self.catalog.publish([relation])
        with self.opening:
            self.unopened.pop(name, None)
            if callable(df):
                self.unopened[name] = df
            else:
                self.adopt(df).createOrReplaceTempView(name)
        return relation

    def open(self, name: str) -> None:
        """Open a relation that waits for its first reader; one reader opens it, others wait."""
        with self.opening:
            if name not in self.unopened:
                return
            df = self.unopened[name]()
            told = self.catalog.current.relation(name).schema
            if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in told]:
                raise CompileError("source_schema", name)
            self.adopt(df).createOrReplaceTempView(name)
            del self.unopened[name]

    def table(self, name: str) -> DataFrame:
        for n in {name} | self.dependencies(name):
            self.open(n)
        return self.spark.table(name)

    def adopt(self, df: DataFrame) -> DataFrame:
        """The same plan in this engine's session."""
        if df.sparkSession is self.spark:
            return df
        return DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan()), self.spark)

    def view(self, name: str, sql: str, meaning: C.Meaning | None = None) -> C.Relation:
        """A view over registered relations; nothing is computed."""
        depends = self.gate(sql)
        if name in self.catalog.current.relations and (name in depends or name in {d for x in depends for d in self.dependencies(x)}):
            raise CompileError("view_lineage", f"{name} depends on itself")
        df = self.spark.sql(sql)
        relation = C.Relation(name, df.schema, "view", sql, tuple(sorted(depends)), meaning=meaning or C.Meaning())
        self.catalog.publish([relation])
        df.createOrReplaceTempView(name)
        return relation

    def dependencies(self, name: str) -> set[str]:
        """All relations that a relation reads, directly or not."""
        out: set[str] = set()
        for d in self.catalog.current.relation(name).dependencies:
            out |= {d} | self.dependencies(d)
        return out

    # -- SQL -------------------------------------------------------------------------------------------------

    def gate(self, sql: str) -> set[str]:
        """Refuse what doesn't only read registered relations; gives their names."""
        nodes, relations = plan_facts(self.spark, sql)
        if extra := nodes - READ_ONLY:
            raise CompileError("read_only", ", ".join(sorted(extra)))
        names = set()
        for parts in relations:
            if len(parts) != 1 or parts[0] not in self.catalog.current.relations:
                raise CompileError("unknown_relation", ".".join(parts))
            names.add(parts[0])
        for n in names | {d for n in names for d in self.dependencies(n)}:
            self.open(n)
        return names

    def sql(self, text: str, parameters: list | None = None) -> DataFrame:
        """A read-only query; ``$1``, ``$2`` ... stand for the parameters, which never become part of the text."""
        args = None
        if parameters is not None:
            used = {int(n) for n in re.findall(r"\$(\d+)", text)}
            if used != set(range(1, len(parameters) + 1)):
                raise CompileError("parameter_count")
            text, args = re.sub(r"\$(\d+)", r":p\1", text), {f"p{i}": v for i, v in enumerate(parameters, 1)}
        self.gate(text)
        key = (self.catalog.current.revision, text)
        with self.lock:
            if args is None and key in self.plans:
                return self.plans[key]
            df = self.spark.sql(text, args=args) if args else self.spark.sql(text)
            if args is None:
                if len(self.plans) >= 8:
                    self.plans.pop(next(iter(self.plans)))
                self.plans[key] = df
        return df

    def plan_sql(self, text: str) -> dict:
        """What a read-only query reads, gives and does, without running it."""
        names = sorted(self.gate(text))
        df = self.sql(text)
        return {"relations": names, "below": sorted({d for n in names for d in self.dependencies(n)}), "columns": [(f.name, f.dataType.simpleString()) for f in df.schema], "plan": df._jdf.queryExecution().optimizedPlan().toString()}

    def prepare_sql(self, text: str, types: list[str]) -> "PreparedSql":
        return PreparedSql(self, text, types)

    # -- writes ----------------------------------------------------------------------------------------------

    def bind(self, name: str, table: Generations, meaning: C.Meaning | None = None) -> C.Relation:
        """A relation that can be written, over a versioned table."""
        relation = self.register(name, table.read(), meaning)
        self.bindings[name] = table
        return relation

    def write(self, text: str, parameters: list | None = None) -> Receipt:
        """One INSERT, UPDATE, DELETE or keyed MERGE; after ``REQUIRE IDEMPOTENT``, a MERGE that a second run leaves as it is."""
        from marlstone.plans.writes import run

        receipt, name = run(self, text, parameters or [])
        if receipt.outcome is Outcome.COMMITTED:
            self.adopt(self.bindings[name].read()).createOrReplaceTempView(name)
            with self.lock:  # views over the relation are analysed anew, and plans of earlier states go
                self.plans.clear()
                self.proposals.clear()
                for v in self.catalog.impact(name):
                    self.spark.sql(self.catalog.current.relation(v).sql).createOrReplaceTempView(v)
        return receipt

    def identity(self, *names: str) -> str:
        """What results over these relations depend on: the catalog and the generations of what is written below them; keeps of other states aren't found by it."""
        below = {d for n in names for d in {n} | self.dependencies(n)}
        return f"{self.catalog.current.id} {sorted((n, t.manifest()['generation']) for n, t in self.bindings.items() if n in below)}"

    def tables(self) -> DataFrame:
        """The registered relations and their columns."""
        rows = [(r.name, r.kind, f.name, f.dataType.simpleString(), i) for r in self.catalog.current.relations.values() for i, f in enumerate(r.schema)]
        return self.spark.createDataFrame(rows, "table_name string, kind string, column_name string, data_type string, ordinal int")

    # -- typed queries ---------------------------------------------------------------------------------------

    def rows(self, query: Mapping, allowed: set[str] | None = None, context: TimeContext | None = None, parameters: Mapping | None = None) -> Bound:
        make = lambda: RowCompiler(self.catalog.current, self.table, allowed, context, parameters).compile(query)
        return self.compiled(("rows", query, sorted(allowed) if allowed is not None else None, repr(context), parameters), make, allowed)

    def graph(self, query: Mapping, allowed: set[str] | None = None, context: TimeContext | None = None) -> Bound:
        make = lambda: GraphCompiler(lambda: RowCompiler(self.catalog.current, self.table, allowed, context)).compile(query)
        return self.compiled(("graph", query, sorted(allowed) if allowed is not None else None, repr(context)), make, allowed)

    def compiled(self, what: tuple, make: Callable[[], Bound], allowed: set[str] | None) -> Bound:
        """What the same proposal gave under the same catalog, scope, context and parameters (the latest ``COMPILED`` are kept), or what it gives now."""
        key = (self.catalog.current.revision, json.dumps(what, sort_keys=True, default=repr))
        with self.lock:
            if key in self.proposals:
                self.proposals.move_to_end(key)
                return replace(self.proposals[key])
        made = self.bound(make(), allowed)
        with self.lock:
            self.proposals[key] = made
            while len(self.proposals) > COMPILED:
                self.proposals.popitem(last=False)
        return replace(made)

    def bound(self, b: Bound, allowed: set[str] | None) -> Bound:
        """Tie a compiled query to the snapshot and the scope it was compiled under; both are checked again when it is run."""
        snapshot = self.catalog.current.id
        b.current, b.restricted = (lambda: self.catalog.current.id == snapshot), allowed is not None
        return b

    def compile_with_evidence(self, intent: Mapping, **options) -> Bound:
        """A row query or a graph whose every part names the bytes of the request it comes from."""
        from marlstone.plans import evidence

        if "nodes" in intent["query"]:
            evidence.check_graph(intent)
            return self.graph(intent["query"], **options)
        evidence.check(intent)
        return self.rows(intent["query"], **options)

    def outcome(self, intent: Mapping, **options) -> dict:
        """What became of a proposal: compiled with its columns and relations, in need of clarification, or rejected with the rule it broke."""
        from marlstone.plans.replay import contract
        from marlstone.plans.verify import verify

        try:
            if "evidence" in intent:
                bound = self.compile_with_evidence(intent, **options)
            else:
                bound = (self.graph if "nodes" in intent else self.rows)(intent, **options)
            verify(bound, self.catalog.current)
        except CompileError as e:
            status = "needs_clarification" if e.code in ("unresolved_alternatives", "unresolved_terms") or e.code.startswith("ambiguous_") else "rejected"
            return {"status": status, "code": e.code, "requirement": e.requirement, "message": str(e)}
        return {"status": "compiled", "snapshot": self.catalog.current.id, "columns": contract(bound), "relations": sorted(bound.relations)}

    def prepare(self, query: Mapping, contract: Mapping[str, str]) -> "Prepared":
        return Prepared(self, query, contract)


class Prepared:
    """A row query with typed parameters (at most 16), compiled when they are given."""

    TYPES = {"boolean", "int64", "float64", "utf8", "date32", "timestamp"}

    def __init__(self, engine: Engine, query: Mapping, contract: Mapping[str, str]):
        if len(contract) > 16:
            raise CompileError("parameter_count")
        if set(contract.values()) - self.TYPES:
            raise CompileError("parameter_type")
        self.engine, self.query, self.contract = engine, query, dict(contract)

    def bind(self, values: Mapping[str, Mapping], **options) -> Bound:
        if set(self.contract) - set(values):
            raise CompileError("parameter_missing")
        if set(values) - set(self.contract):
            raise CompileError("parameter_extra")
        if any(values[k].get("type") != t for k, t in self.contract.items()):
            raise CompileError("parameter_type")
        return self.engine.rows(self.query, parameters=values, **options)


class PreparedSql:
    """A read-only query whose parameters ``$1``, ``$2`` ... have declared types (at most 16)."""

    #: Types, as SQL and as the values that are taken (fixed values).
    TYPES = {"boolean": ("boolean", (bool,)), "int16": ("smallint", (int,)), "int32": ("int", (int,)), "int64": ("bigint", (int,)), "float64": ("double", (int, float)), "utf8": ("string", (str,)), "date32": ("date", (dt.date,)), "timestamp": ("timestamp", (dt.datetime,)), "binary": ("binary", (bytes,))}

    def __init__(self, engine: Engine, text: str, types: list[str]):
        if len(types) > 16 or {int(n) for n in re.findall(r"\$(\d+)", text)} != set(range(1, len(types) + 1)):
            raise CompileError("parameter_count")
        if set(types) - set(self.TYPES):
            raise CompileError("parameter_type")
        self.engine, self.types = engine, types
        self.text = re.sub(r"\$(\d+)", lambda m: f"cast(:p{m[1]} as {self.TYPES[types[int(m[1]) - 1]][0]})", text)
        engine.gate(self.text)

    def describe(self) -> dict:
        """Types of the parameters, and names and types of the result's columns."""
        df = self.engine.spark.sql(self.text, args={f"p{i}": None for i in range(1, len(self.types) + 1)})
        return {"parameters": list(self.types), "columns": [(f.name, f.dataType.simpleString()) for f in df.schema]}

    def bind(self, values: list) -> DataFrame:
        if len(values) != len(self.types):
            raise CompileError("parameter_count")
        for v, t in zip(values, self.types):
            taken = self.TYPES[t][1]
            if v is not None and (not isinstance(v, taken) or isinstance(v, bool) != (t == "boolean") or t == "date32" and isinstance(v, dt.datetime)):
                raise CompileError("parameter_type", t)
        self.engine.gate(self.text)
        return self.engine.spark.sql(self.text, args={f"p{i}": v for i, v in enumerate(values, 1)})


def batches(df: DataFrame, seconds: float = 30.0) -> Iterator:
    """Rows of a result as they come, under a deadline; the jobs of a query that runs over, or is given up, are cancelled."""
    context, tag = df.sparkSession.sparkContext, f"query-{uuid.uuid4().hex}"
    context.addJobTag(tag)
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        for row in df.toLocalIterator():
            if over.is_set():
                raise TimeoutError("the query's time is over")
            yield row
    except Exception as e:
        raise TimeoutError("the query's time is over") from e if over.is_set() else e
    finally:
        timer.cancel()
        context.removeJobTag(tag)
