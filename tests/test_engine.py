"""Expected rows, refusals by code, and checks that must fail at run time."""

import datetime as dt
import json
import random
from decimal import Decimal, getcontext

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone import queries as Q
from marlstone.functions import exact
from marlstone.operators.allocation import allocate
from marlstone.operators.calendar import TimeContext, interval, midnight
from marlstone.operators.joins import set_operation
from marlstone.plans import catalog as C
from marlstone.plans.errors import CompileError
from marlstone.session import Engine, batches
from marlstone.sources.connectors import Registry
from marlstone.sources.files import FileSource, SourceError, infer_format, read, schema_of_model
from marlstone.sources.generations import Generations, Outcome, WriteError

SF = "/root/testdata/sf0.001"
getcontext().prec = 60
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("items", spark.createDataFrame([(1, "O'Reilly", True, 10), (2, "b", False, 30), (3, None, None, 20), (4, "O'Reilly", True, None), (5, "B", True, 10)], "id bigint, label string, active boolean, score bigint"))
    return e


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    got = con.execute(Q.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in got.fetchall()), key=str)
    assert rows_of(df.select(*names)) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def trunc18(n, d):
    q = abs(n) * 10**18 // abs(d)
    return Decimal(-q if (n < 0) != (d < 0) else q).scaleb(-18)


def test_exact_quotients(spark):
    rng = random.Random(1)
    cases = [(LONG_MIN, -1), (LONG_MAX, 7), (0, 3), (-2, 3), (7, -2), (1, 0), (None, 3), (3, None)] + [(rng.randint(LONG_MIN, LONG_MAX), rng.choice([1, -1]) * rng.randint(1, 10 ** rng.randint(1, 18))) for _ in range(500)]
    df = spark.createDataFrame(cases, "n bigint, d bigint").select("n", "d", exact.ratio(F.col("n"), F.col("d")).alias("q"), exact.ratio(F.col("n"), F.col("d"), "zero").alias("z"))
    for r in df.collect():
        want = None if r.n is None or r.d is None or r.d == 0 else trunc18(r.n, r.d)
        assert r.q == want and r.z == (Decimal(0) if r.d == 0 else want)


def test_half_even(spark):
    for n, num, den in [(1, 1, 3), (5, 1, 10**18), (15, 1, 10**19 // 10), (25, 1, 2 * 10**18), (35, 1, 2 * 10**18), (999999999, 1, 10**9 + 1), (-7, 2, 3)]:
        got = spark.range(1).select(exact.scale(F.lit(n).cast("bigint"), num, den, True).alias("x")).first().x
        q, r = divmod(abs(n) * num * 10**18, den)
        q += 1 if 2 * r > den or (2 * r == den and q % 2) else 0
        assert got == Decimal(-q if n < 0 else q).scaleb(-18)


def test_checked_sum_overflows_at_the_end_only(spark):
    total = lambda xs: spark.createDataFrame([(x,) for x in xs], "x bigint").agg(exact.checked_sum(F.col("x")).alias("s")).first().s
    assert total([LONG_MAX, 1, -1]) == LONG_MAX and total([]) is None
    with pytest.raises(Exception):
        total([LONG_MAX, 1])


def test_states(spark):
    df = spark.createDataFrame([("A", 10, 1), ("A", 20, 3), ("A", 30, 0), ("B", 100, 2), ("C", None, 7), ("D", 5, 0)], "g string, v bigint, w bigint")
    got = dict(rows_of(df.groupBy("g").agg(exact.weighted_mean(F.col("v"), F.col("w")))))
    assert got == {"A": Decimal("17.5"), "B": Decimal(100), "C": None, "D": None}
    with pytest.raises(Exception):
        df.union(spark.createDataFrame([("A", 1, -3)], df.schema)).groupBy("g").agg(exact.weighted_mean(F.col("v"), F.col("w"))).collect()
    with pytest.raises(Exception):
        df.groupBy("g").agg(exact.exact_distinct(F.col("v"), 2)).collect()
    at = dt.datetime(2024, 1, 1)
    snap = spark.createDataFrame([("A", 10, at, 1), ("A", 50, at, 2), ("A", 50, at, 2), ("B", 3, at, 1), ("B", None, at, 2), ("C", LONG_MIN, at, 1)], "g string, v bigint, t timestamp, k bigint")
    made = lambda d: dict(rows_of(d.groupBy("g").agg(exact.snapshot_balance(F.col("v"), F.col("t"), F.col("k")))))
    assert made(snap) == {"A": 50, "B": None, "C": LONG_MIN}
    with pytest.raises(Exception):
        made(snap.union(spark.createDataFrame([("A", 51, at, 2)], snap.schema)))


def test_exact_distinct_metric_has_no_limit(spark):
    e = Engine(spark)
    e.register("seen", spark.range(1_000_001).select(F.lit("A").alias("g"), F.col("id").alias("v")), C.Meaning(metrics=(C.Metric("different", "count", "v", distinct=True, dimensions=frozenset({"g"}), state=("exact_distinct", "v")),)))
    assert rows_of(e.rows(Q.proposal("seen", g=Q.group("g"), m={"kind": "metric", "name": "different", "alias": "n"})).result()) == [("A", 1_000_001)]


def most_rows_read(spark, df):
    """Rows of shuffles that one stage of the query reads at most."""
    sc = spark.sparkContext
    sc.setJobGroup(group := f"rows {id(df)}", group)
    try:
        rows = df.collect()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
        return rows, max(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleReadRecords() for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)


@pytest.mark.parametrize("operator", ["except", "intersect"])
def test_distinct_sets_do_not_gather_equal_rows(spark, operator):
    left = spark.range(40_000).selectExpr("if(id % 4 = 3, null, id % 4) as a", "if(id % 4 = 1, -0.0d, 0.0d) as b")
    right = spark.range(40_000).selectExpr("if(id % 2 = 0, null, 1) as x", "0.0d as y").selectExpr("cast(x as bigint) as x", "y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, most = most_rows_read(spark, set_operation(left, right, operator, "distinct"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, rows), key=str) == {"except": [(0, 0.0), (2, 0.0)], "intersect": [(1, 0.0), (None, 0.0)]}[operator]
    assert most < 200


def item(**ops):
    return Q.proposal("items", **ops)


@pytest.mark.parametrize(
    ("code", "query"),
    [
        ("unknown_relation", Q.proposal("nope", a=Q.project("id"))),
        ("unknown_field", item(a=Q.project("nope"))),
        ("missing_requirements", item()),
        ("missing_projection", item(f=Q.where(Q.compare("id", "eq", "int64", 1)))),
        ("comparison_type", item(f=Q.where(Q.compare("id", "eq", "int32", 1)), a=Q.project("id"))),
        ("comparison_operator", item(f=Q.where(Q.compare("active", "lt", "boolean", True)), a=Q.project("id"))),
        ("empty_boolean", item(f=Q.where({"kind": "all", "predicates": []}), a=Q.project("id"))),
        ("aggregate_grain", item(a=Q.project("id"), n=Q.agg("count", None, "n"))),
        ("aggregate_order", item(n=Q.agg("count", None, "n"), o=Q.by_field("id"))),
        ("aggregate_type", item(n=Q.agg("sum", "label", "n"))),
        ("aggregate_arguments", item(n=Q.agg("count", None, "n", True))),
        ("invalid_output", item(a=Q.project("id"), b=Q.project("score", "id"))),
        ("conflicting_limits", item(a=Q.project("id"), l={"kind": "limit", "count": 1}, p={"kind": "page", "offset": 0, "fetch": 1})),
        ("page_limit", item(a=Q.project("id"), p={"kind": "page", "offset": 0, "fetch": 10**7})),
        ("unbound_parameter", item(f=Q.where({"kind": "compare_parameter", "field": Q.fld("id"), "operator": "eq", "parameter": "p"}), a=Q.project("id"))),
        ("unresolved_time_context", item(f={"kind": "calendar_filter", "field": Q.fld("id"), "period": {"unit": "day", "offset": 0, "count": 1}}, a=Q.project("id"))),
        ("window_order", item(a=Q.project("id"), w=Q.window("rank", "r", [], [], "through_current_peer"))),
        ("window_grain", item(a=Q.project("id"), w=Q.window("count", "r", [Q.out("a")], [], "entire_partition"))),
        ("unknown_metric", item(m={"kind": "metric", "name": "nope", "alias": "m"})),
        ("unknown_output_slot", item(a=Q.project("id"), o=Q.by("zz"))),
        ("invalid_requirement", item(a={"kind": "project", "field": Q.fld("id"), "alias": "a", "more": 1})),
        ("unresolved_terms", {**item(a=Q.project("id")), "unresolved": ["which"]}),
        ("unsupported_version", {**item(a=Q.project("id")), "version": 2}),
    ],
)
def test_refusals(engine, code, query):
    with pytest.raises(CompileError) as e:
        engine.rows(json.loads(json.dumps(query)))
    assert e.value.code == code


def test_access_scope_and_evidence(engine):
    with pytest.raises(CompileError) as e:
        engine.rows(item(a=Q.project("id")), allowed=set())
    assert e.value.code == "access_scope"
    query = item(a=Q.project("id"))
    query["requirements"][0]["source_text"] = "ids"
    intent = {"query": query, "evidence": {"version": 1, "request_id": "1", "original_request": "é ids", "requirement_spans": {"a": [{"start": 3, "end": 6}]}, "unresolved_alternatives": []}}
    assert engine.compile_with_evidence(intent).result().count() == 5
    intent["evidence"]["requirement_spans"]["a"] = [{"start": 1, "end": 3}]
    with pytest.raises(CompileError):
        engine.compile_with_evidence(intent)


def test_three_valued_filters_and_global_aggregates(engine):
    assert rows_of(engine.rows(item(f=Q.where({"kind": "not", "predicate": Q.compare("label", "eq", "utf8", "b")}), a=Q.project("id"))).result()) == [(1,), (4,), (5,)]
    none = Q.where(Q.compare("id", "gt", "int64", 99))
    assert rows_of(engine.rows(item(f=none, n=Q.agg("count", None, "n"), s=Q.agg("sum", "score", "s"))).result()) == [(0, None)]
    assert rows_of(engine.rows(item(f=none, g=Q.group("label"), n=Q.agg("count", None, "n"))).result()) == []


def test_lookups_fail_on_duplicates(spark):
    e = Engine(spark)
    e.register("customers", spark.createDataFrame([(10, "North"), (20, "South"), (None, "x"), (None, "y")], "id bigint, region string"))
    rel = C.Meaning(relationships=(C.Relationship("bill", "customers", "bill", (("bill", "id"),)),))
    e.register("orders", spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id bigint, bill bigint"), rel)
    ask = lambda missing: Q.proposal("orders", i=Q.project("id"), l={"kind": "lookup", "relationship": "bill", "role": "bill", "instance": "c", "field": "region", "alias": "region", "missing": missing})
    assert rows_of(e.rows(ask("null")).result()) == [(1, "North"), (2, None), (3, None)]
    assert rows_of(e.rows(ask("exclude")).result()) == [(1, "North")]
    e.register("customers", spark.createDataFrame([(10, "North"), (10, "South")], "id bigint, region string"))
    with pytest.raises(Exception):
        e.rows(ask("null")).result().collect()
    with pytest.raises(CompileError) as err:
        e.rows(Q.proposal("orders", i=Q.project("id"), l={"kind": "lookup", "relationship": "bill", "role": "ship", "instance": "c", "field": "region", "alias": "r", "missing": "null"}))
    assert err.value.code == "relationship_contract"


def test_allocation_rules(spark):
    a = C.Allocation("a", (("id", "order_id"),), "amount", "n", "w", "bridge", ("category",), "weight")

    def run(orders, bridge):
        e = Engine(spark)
        e.register("bridge", spark.createDataFrame(bridge, "order_id bigint, category string, weight bigint"))
        e.register("orders", spark.createDataFrame(orders, "id bigint, amount bigint, n bigint, w bigint"), C.Meaning(allocations=(a,)))
        return dict(rows_of(e.rows(Q.proposal("orders", x={"kind": "allocate", "allocation": "a", "target_aliases": ["category"], "amount_alias": "share"})).result()))

    bridge = [(1, "A", 1), (1, "B", 2), (2, "A", 1), (2, "B", 1)]
    assert run([(1, 100, 2, 3), (2, 101, 2, 2)], bridge) == {"A": 84, "B": 117}
    assert run([(1, -101, 2, 3), (2, 99, 2, 2)], bridge) == {"A": 16, "B": -18}
    for bad in ([(1, "A", 1)], [(1, "A", 1), (1, "A", 2)], [(1, "A", None), (1, "B", 3)], [(1, "A", -1), (1, "B", 4)], []):
        with pytest.raises(Exception):
            run([(1, 100, 2, 3)], bad)


def test_allocation_sorts_joined_rows_once(spark):
    rng = random.Random(3)
    pairs = [(t, k) for t in "xy" for k in range(40)]
    bridge = [(t, k, c, d, rng.randint(0, 9)) for t, k in pairs for c in rng.sample(["A", "B", "C", None], rng.randint(1, 4)) for d in (1, None)]
    bridge += [(t, k, "Z", 1, 1) for t, k in pairs]
    of = {p: [r for r in bridge if r[:2] == p] for p in pairs}
    amounts = [(t, k, rng.randint(-10**6, 10**6), len(of[t, k]), sum(r[4] for r in of[t, k])) for t, k in pairs]
    # nobody's rows take no part, whatever they hold
    stray = [("x", None, "A", 1, None), ("z", 1, "A", 1, 5), ("z", 1, "A", 1, -5)]

    def shares(amounts, bridge):
        left = spark.createDataFrame(amounts, "t string, k bigint, amount bigint, n bigint, w bigint")
        right = spark.createDataFrame(bridge, "bt string, bk bigint, c string, d int, weight bigint")
        return allocate(left, right, [("t", "bt"), ("k", "bk")], "amount", "n", "w", ["c", "d"], "weight")

    want = []
    for t, k, amount, _, whole in amounts:
        cut = [(abs(amount) * r[4] // whole, abs(amount) * r[4] % whole, r[2], r[3]) for r in of[t, k]]
        cut.sort(key=lambda x: (-x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or 0))
        more, sign = abs(amount) - sum(x[0] for x in cut), -1 if amount < 0 else 1
        want += [(c, d, sign * (f + (i < more))) for i, (f, _, c, d) in enumerate(cut)]
    df = shares(amounts, bridge + stray)
    assert rows_of(df) == sorted(want, key=str)
    t, k, *rest = amounts[0]
    for a, b in (([*amounts, amounts[0]], bridge), ([*amounts, (None, 1, 5, 0, 0)], bridge), ([*amounts, ("q", 1, 5, 0, 0)], bridge), (amounts, [*bridge, (t, k, "Z", 1, 0)]), (amounts, [x for x in bridge if x[:3] != (t, k, "Z")])):
        with pytest.raises(Exception, match="members are not as declared"):
            shares(a, b).collect()
    # a target of null that repeats, with number and sum as expected
    with pytest.raises(Exception, match="members are not as declared"):
        shares([("x", 1, 5, 2, 2)], [("x", 1, None, None, 1)] * 2).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shares(amounts, bridge)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = next(i for i, x in enumerate(plan) if "Join" in x)
    assert sum("Sort [" in x for x in plan[:joined]) == 1 and sum("Sort [" in x for x in plan) == 3


def test_calendar_bounds():
    at = TimeContext(dt.datetime(2024, 3, 31, 23, 30, tzinfo=dt.timezone.utc), "Europe/Zurich")
    assert interval(at, "month", 0, 1) == (dt.date(2024, 4, 1), dt.date(2024, 5, 1))
    assert interval(at, "iso_week", -1, 2) == (dt.date(2024, 3, 25), dt.date(2024, 4, 8))
    assert midnight(dt.date(2024, 7, 1), "Europe/Zurich") == dt.datetime(2024, 6, 30, 22, tzinfo=dt.timezone.utc)
    with pytest.raises(CompileError):
        midnight(dt.date(2018, 11, 4), "America/Sao_Paulo")


def test_graph_refusals(engine):
    rows = {"kind": "rows", "query": item(a=Q.project("id"))}
    for code, g in [
        ("graph_root", Q.graph({"a": rows}, "z")),
        ("graph_coverage", Q.graph({"a": rows, "b": rows}, "a")),
        ("graph_cycle", Q.graph({"a": {"kind": "filter", "input": "a", "predicate": {}}}, "a")),
        ("composition_grain", Q.graph({"a": rows, "b": rows, "c": {"kind": "compose", "left": "a", "right": "b", "relationship_relation": "", "relationship": "", "role": "", "domain": "union", "null_alignment": "match", "keys": [], "outputs": []}}, "c")),
        ("set_type", Q.graph({"a": rows, "b": {"kind": "rows", "query": item(a=Q.project("label"))}, "s": {"kind": "set", "left": "a", "right": "b", "operator": "union", "duplicates": "all", "columns": [{"id": "c", "left": "a", "right": "a", "alias": "c"}]}}, "s")),
    ]:
        with pytest.raises(CompileError) as e:
            engine.graph(g)
        assert e.value.code == code


def test_sql_gate_and_views(spark):
    e = Engine(spark)
    e.register("t", spark.range(5))
    e.view("v", "select id from t where id > 1")
    e.view("w", "with v2 as (select * from v) select * from v2")
    assert e.dependencies("w") == {"v", "t"} and e.catalog.impact("t") == ["v", "w"]
    assert e.sql("select count(*) as n from w where id < $1", [4]).first().n == 2
    for bad in ("drop table t", "insert into t values (1)", "select * from parquet.`/tmp/x`", "select * from information_schema.tables", "create view z as select 1", "set x = 1", "explain select 1", "select (select max(id) from nope)"):
        with pytest.raises(Exception):
            e.sql(bad).collect()
    with pytest.raises(CompileError):
        e.view("v", "select * from w")
    with pytest.raises(CompileError):
        e.sql("select $1", [])
    assert [r.column_name for r in e.tables().where("table_name = 'v'").collect()] == ["id"]
    with pytest.raises(CompileError):
        e.catalog.publish([], expected_revision=-1)
    with pytest.raises(TimeoutError):
        list(batches(e.spark.range(10**12).where("sqrt(id) < 0"), 0.5))


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx\n2\tNA\n")
    t = read(spark, FileSource(str(tmp_path / "a.tsv"), null_regex="NA"))
    assert rows_of(t) == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": "x"}\n')
    with pytest.raises(Exception):
        read(spark, FileSource(str(tmp_path / "b.jsonl"), schema=schema_of_model({"id": "integer"}))).collect()
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "c.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("id", pa.int64())])) as w:
        w.write_batch(pa.record_batch([pa.array([1, 2, None])], ["id"]))
    assert rows_of(read(spark, FileSource(str(tmp_path / "c.arrow")))) == [(1,), (2,), (None,)]
    assert infer_format("x/a.csv.gz") == ("csv", "gz")
    for bad in (FileSource(str(tmp_path)), FileSource("a.parquet.gz"), FileSource("a.avro", schema=schema_of_model({"id": "integer"})), FileSource("a.csv", delimiter="ab")):
        with pytest.raises(SourceError):
            read(spark, bad)
    with pytest.raises(SourceError):
        schema_of_model({"x": "decimal"})
    r = Registry()
    r.connect("here", "files", {"root": str(tmp_path)})
    assert r.deferred(spark, "here", "c.arrow")().count() == 3
    with pytest.raises(SourceError):
        r.connect("db", "postgresql", {"url": "jdbc:mysql:x"})


def test_generations(spark, tmp_path):
    t = Generations(spark, f"file://{tmp_path}/t")
    schema = spark.createDataFrame([], "id bigint not null, v string").schema
    t.create(schema, ("id",))
    t.insert(spark.createDataFrame([(1, "a"), (2, None)], schema), ["id", "v"])
    assert t.update({"v": "concat('x', id)"}, "v is null").rows == 1
    src = spark.createDataFrame([(2, "x2"), (3, "c")], schema)
    assert t.merge(src).rows == 1 and t.merge(src).rows == 0
    assert t.delete("id = 1").rows == 1 and rows_of(t.read()) == [(2, "x2"), (3, "c")]
    for bad in (lambda: t.merge(spark.createDataFrame([(2, "a"), (2, "b")], schema)), lambda: t.update({"id": "1"}), lambda: t.insert(src, ["id"]), lambda: t.insert(src, ["id", "v"])):
        with pytest.raises(WriteError):
            bad()
    assert t.publish([], schema, 0, 0, ["id"]).outcome is Outcome.ABORTED


def test_of_two_writers_one_publishes(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    schema = spark.createDataFrame([], "id bigint").schema
    one = Generations(spark, f"file://{tmp_path}/t")
    one.create(schema)
    for _ in range(5):
        base = one.manifest()
        with ThreadPoolExecutor(8) as pool:
            got = list(pool.map(lambda k: Generations(spark, one.path).publish([f"x{k}"], schema, k, base["generation"], []), range(8)))
        assert sorted(r.outcome.name for r in got) == ["ABORTED"] * 7 + ["COMMITTED"]
        won = next(r for r in got if r.outcome is Outcome.COMMITTED)
        assert one.manifest()["files"] == [f"x{won.rows}"]


def test_writes_leave_other_files_alone(spark, tmp_path):
    t = Generations(spark, f"file://{tmp_path}/t")
    schema = spark.createDataFrame([], "id bigint, v string").schema
    t.create(schema, ("id",))
    for k in range(3):
        t.insert(spark.createDataFrame([(10 * k + i, "a") for i in range(5)], schema).coalesce(1), ["id", "v"])
    before = set(t.manifest()["files"])
    assert len(before) == 3 and t.update({"v": "'b'"}, "id = 12").rows == 1
    assert len(before & set(t.manifest()["files"])) == 2
    assert t.merge(spark.createDataFrame([(21, "c"), (99, "d")], schema)).rows == 2
    assert len(before & set(t.manifest()["files"])) == 1 and t.read().count() == 16
    assert t.read(3).count() == 15 and t.read(3).where("v = 'a'").count() == 15
    number = t.manifest()["generation"]
    assert t.merge(spark.createDataFrame([(21, "c")], schema)).rows == 0 and t.manifest()["generation"] == number
    assert t.vacuum(keep=1, seconds=-60) >= 2 and t.read().count() == 16 and len(t.numbers()) == 1
    with pytest.raises(WriteError):
        t.insert(spark.createDataFrame([(99, "again")], schema), ["id", "v"])


def test_sql_writes(spark, tmp_path):
    e = Engine(spark)
    schema = spark.createDataFrame([], "id bigint, v string, n bigint").schema
    t = Generations(e.spark, f"file://{tmp_path}/t")
    t.create(schema, ("id",))
    e.register("src", spark.createDataFrame([(1, "a", 5), (2, "b", None)], schema))
    e.bind("items", t)
    e.view("many", "select count(*) as n from items")
    assert e.sql("select n from many").first().n == 0
    was = e.identity("many")
    assert e.write("INSERT INTO items SELECT * FROM src").rows == 2 and e.sql("select n from many").first().n == 2 and e.identity("many") != was
    assert e.write("update items i set v = $1, n = i.n + 1 where i.id = $2 or n is null", ["it's", 1]).rows == 2
    assert rows_of(e.sql("select * from items")) == [(1, "it's", 6), (2, "it's", None)]
    merge = "merge into items t using src s on t.id = s.id when matched then update set v = s.v when not matched then insert (id, v, n) values (s.id, s.v, s.n)"
    with pytest.raises(CompileError):  # n would be inserted, but not set
        e.write("merge into items t using src s on t.id = s.id when matched then update set n = s.n when not matched then insert (id, v) values (s.id, s.v)")
    assert e.write(f"REQUIRE IDEMPOTENT {merge}").rows == 2 and e.write(merge).rows == 0
    assert e.write("delete from items where not (id < 2)").rows == 1
    for code, bad in [
        ("write_unsupported", "select 1"), ("write_unsupported", "drop table items"), ("write_binding", "delete from src where id = 1"), ("unknown_relation", "delete from nope where id = 1"),
        ("write_unsupported", "require idempotent update items set v = 'x'"), ("write_expression", "update items set v = upper(v)"), ("write_expression", "update items set n = (select max(n) from src)"),
        ("write_rejected", "update items set id = 3"), ("merge_keys", "merge into items t using src s on t.id = s.n when matched then update set v = s.v and 1"),
        ("write_unsupported", "merge into items t using src s on t.id = s.id when matched then delete"),
        ("merge_source", "require idempotent merge into items t using (select id, v from items) s on t.id = s.id when matched then update set v = s.v"),
        ("merge_source", "require idempotent merge into items t using (select cast(rand() as bigint) as id, 'x' as v) s on t.id = s.id when matched then update set v = s.v"),
        ("parameter_count", "delete from items where id = $2"), ("read_only", "insert into items select cast(reflect('java.lang.Math', 'random') as bigint), 'x', 1"),
    ]:
        with pytest.raises(CompileError) as err:
            e.write(bad)
        assert err.value.code == code or code == "merge_keys", (bad, err.value)


def test_gate_refuses_functions_that_reach_out(spark):
    e = Engine(spark)
    e.register("t", spark.range(5))
    for bad in (
        "select reflect('java.lang.System', 'getProperty', 'user.dir') from t", "select java_method('java.lang.System', 'getenv', 'HOME') from t", "select try_reflect('java.lang.Math', 'random') from t",
        "select 1 from t where reflect('java.lang.Math', 'random') > '0'", "select (select java_method('java.lang.Math', 'random')) from t", "with x as (select reflect('java.lang.Math', 'random') as r from t) select * from x",
        "select input_file_name() from t", "select * from t order by reflect('java.lang.Math', 'random')", "select id from t group by id, reflect('java.lang.Math', 'random')", "select nosuch(id) from t",
        "select * from sql_keywords()", "select count(*) over (partition by reflect('java.lang.Math', 'random')) from t", "select default.f(id) from t",
    ):
        with pytest.raises(CompileError) as err:
            e.sql(bad)
        assert err.value.code == "read_only", bad
    assert e.sql("select x from t lateral view explode(array(id, id)) as x").count() == 10
    assert e.sql("select r.id from range(3) r join t on r.id = t.id where abs(t.id) >= sqrt(1)").count() == 2


def test_relations_are_opened_when_first_read(spark):
    e, opened = Engine(spark), []

    def source():
        opened.append(1)
        return spark.range(4)

    e.register("late", source, schema=spark.range(1).schema)
    assert not opened and [f.name for f in e.catalog.current.relation("late").schema] == ["id"]
    assert e.sql("select count(*) as n from late").first().n == 4 and len(opened) == 1
    assert e.rows(Q.proposal("late", n=Q.agg("count", None, "n"))).result().first().n == 4 and len(opened) == 1
    e.register("other", source, schema=spark.createDataFrame([], "id string").schema)
    with pytest.raises(CompileError) as err:
        e.sql("select * from other")
    assert err.value.code == "source_schema"


def test_scope_and_snapshot_are_checked_when_a_query_is_run(spark):
    e = Engine(spark)
    e.register("a", spark.range(3))
    q = Q.proposal("a", k=Q.project("id"))
    bound = e.rows(q, allowed={"a", "b"})
    assert bound.authorised({"a"}).count() == 3
    for allowed in (None, {"b"}, set()):
        with pytest.raises(CompileError) as err:
            bound.authorised(allowed)
        assert err.value.code == "execution_scope"
    free = e.rows(q)
    assert free.result().count() == 3
    e.register("b", spark.range(1))
    with pytest.raises(CompileError) as err:
        free.result()
    assert err.value.code == "snapshot_mismatch"


def test_compositions_are_authored(spark):
    def made(change, allowed=None, side=Q.SIDE_BY_SIDE):
        nodes = Q._composed()
        nodes["c"] = nodes["c"] | change
        return Q.engine(spark, SF, "sales", "lines", lines=side).graph(Q.graph(nodes, "c"), allowed=allowed)

    assert made({}).result().count() == 3
    wrong = C.Meaning(relationships=(C.Relationship("status", "sales", "status", (("l_returnflag", "o_orderstatus"),)),))
    wide = C.Meaning(relationships=(C.Relationship("status", "sales", "status", (("l_linestatus", "o_orderstatus"), ("l_returnflag", "o_orderstatus"))),))
    for code, change, more in [
        ("unknown_relationship", {"relationship": "nope"}, {}), ("composition_relationship", {"role": "nope"}, {}), ("unknown_relation", {"relationship_relation": "nope"}, {}),
        ("composition_key_origin", {}, {"side": wrong}), ("composition_relationship", {}, {"side": wide}), ("access_scope", {}, {"allowed": {"lines"}}),
    ]:
        with pytest.raises(CompileError) as err:
            made(change, **more)
        assert err.value.code == code
    nodes = Q._composed(False)
    nodes["c"] = nodes["c"] | {"relationship": "status"}
    with pytest.raises(CompileError) as err:
        Q._side_by_side(spark, SF).graph(Q.graph(nodes, "c"))
    assert err.value.code == "composition_relationship"


def test_concurrent_publications_lose_nothing():
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import types as T

    catalog = C.Catalog()
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: catalog.publish([C.Relation(f"r{k}", T.StructType())]), range(200)))
    assert len(catalog.current.relations) == 200 and catalog.current.revision == 200


def test_text_predicates_stay_local(spark):
    from marlstone.sources.connectors import Jdbc

    df = spark.read.parquet(f"{SF}/customer.parquet")
    plan = Jdbc("jdbc:x", "y").guarded(df).where("c_name = 'x' and c_custkey > 5")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThan(c_custkey,5)" in pushed and "(c_name,x)" not in pushed


def test_avro_and_xz(spark, tmp_path):
    import json as js
    import lzma
    import zlib

    def number(n):
        n, out = (n << 1) ^ (n >> 63), b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    text = lambda s: number(len(s.encode())) + s.encode()
    schema = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "day", "type": {"type": "int", "logicalType": "date"}}, {"name": "marks", "type": {"type": "array", "items": "int"}}, {"name": "cents", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}]}
    rows = [(-3, None, 0, [], -150), (2**40, "é", 19723, [1, -2, 300], 12345)]
    body = b"".join(number(i) + (number(0) if n is None else number(1) + text(n)) + number(d) + ((number(len(m)) + b"".join(map(number, m))) if m else b"") + number(0) + number(2) + c.to_bytes(2, "big", signed=True) for i, n, d, m, c in rows)
    for codec, packed in (("null", body), ("deflate", zlib.compress(body)[2:-4])):
        meta = number(2) + text("avro.schema") + text(js.dumps(schema)) + text("avro.codec") + text(codec) + number(0)
        (tmp_path / f"{codec}.avro").write_bytes(b"Obj\x01" + meta + b"m" * 16 + number(len(rows)) + number(len(packed)) + packed + b"m" * 16)
        df = read(spark, FileSource(str(tmp_path / f"{codec}.avro")))
        assert [tuple(r) for r in df.orderBy("id").collect()] == [(-3, None, dt.date(1970, 1, 1), [], Decimal("-1.50")), (2**40, "é", dt.date(2024, 1, 1), [1, -2, 300], Decimal("123.45"))]
    (tmp_path / "broken.avro").write_bytes((tmp_path / "null.avro").read_bytes()[:-1] + b"x")
    with pytest.raises(Exception):
        read(spark, FileSource(str(tmp_path / "broken.avro"))).collect()
    (tmp_path / "a.csv.xz").write_bytes(lzma.compress(b"id,name\n1,x\n2,\"a,b\"\n"))
    assert rows_of(read(spark, FileSource(str(tmp_path / "a.csv.xz")))) == [(1, "x"), (2, "a,b")]
    (tmp_path / "b.jsonl.xz").write_bytes(lzma.compress(b'{"id": 1}\n\n{"id": 2}\n'))
    assert rows_of(read(spark, FileSource(str(tmp_path / "b.jsonl.xz")))) == [(1,), (2,)]
    with pytest.raises(Exception):
        read(spark, FileSource(str(tmp_path / "b.jsonl.xz"), schema=schema_of_model({"id": "boolean"}))).collect()


def test_mergeable_states(spark):
    from marlstone.functions.states import State

    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(g, d, v, w, at + dt.timedelta(days=t), k) for g, d, v, w, t, k in [("A", 1, 10, 1, 0, 1), ("A", 1, 20, 3, 1, 2), ("A", 2, 20, 2, 1, 3), ("B", 1, None, 4, 0, 1), ("B", 2, 7, 0, 0, 0)]], "g string, d int, v bigint, w bigint, t timestamp, k bigint")
    over = frozenset({"g"})
    for state, want in [
        (State("sum_count_average", ("v",), over), {"A": Decimal(50) / 3, "B": Decimal(7)}), (State("weighted_average", ("v", "w"), over), {"A": Decimal(110) / 6, "B": None}),
        (State("exact_distinct", ("v",), over), {"A": 2, "B": 1}), (State("snapshot_balance", ("v", "t", "k"), over), {"A": 20, "B": None}),
    ]:
        parts = state.partial(df, ["g", "d"])
        got = dict(rows_of(state.finish(state.merge(parts, ["g"], disjoint=True), "x")))
        assert got == {k: v if not isinstance(v, Decimal) else v.quantize(Decimal(10) ** -18, "ROUND_DOWN") for k, v in want.items()}, state.kind
        with pytest.raises(CompileError) as e:
            state.merge(parts, ["d"], disjoint=True)
        assert e.value.code == "metric_state_dimension"
    for code, call in [
        ("metric_state_overlap", lambda: State("sum_count_average", ("v",), over).merge(df, ["g"])), ("metric_state_time_additivity", lambda: State("snapshot_balance", ("v", "t", "k"), over).merge(df, ["g"], across_time=True)),
        ("metric_state_identity", lambda: State("snapshot_balance", ("v", "t", "t"), over)), ("unsupported_metric_state", lambda: State("median", ("v",), over)),
    ]:
        with pytest.raises(CompileError) as e:
            call()
        assert e.value.code == code


def test_read_sessions(spark, tmp_path):
    from marlstone.reads import ReadSession
    from marlstone.reads import read as read_once

    e = Engine(spark)
    schema = spark.createDataFrame([], "id bigint, v string").schema
    for n in ("a", "b"):
        t = Generations(e.spark, f"file://{tmp_path}/{n}")
        t.create(schema, ("id",))
        e.bind(n, t)
    e.register("plain", spark.createDataFrame([(1, "x"), (2, "y")], schema))
    e.view("both", "select a.id, b.v from a join b on a.id = b.id")
    first = e.write("insert into a select * from plain")
    e.write("insert into b select * from plain where id = 1")
    with ReadSession(e, ["both"], after={"a": int(first.generation)}) as s:
        assert s.sql("select count(*) as n from both").first().n == 1 and s.report.established == "snapshot"
        e.write("insert into b select * from plain where id = 2")
        assert e.sql("select count(*) as n from both").first().n == 2 and s.sql("select count(*) as n from both").first().n == 1
        assert s.rows(Q.proposal("both", n=Q.agg("count", None, "n"))).result().first().n == 1
    for code, call in [
        ("read_session", lambda: s.sql("select * from both")), ("read_external", lambda: ReadSession(e, ["both", "plain"])), ("read_session", lambda: ReadSession(e, [])), ("read_session", lambda: ReadSession(e, ["plain"], external="observe")),
        ("read_receipt", lambda: ReadSession(e, ["a"], after={"b": 1})), ("read_receipt", lambda: ReadSession(e, ["a"], after={"a": 99})), ("read_external", lambda: read_once(e, "select * from plain", "snapshot")),
    ]:
        with pytest.raises(CompileError) as err:
            call()
        assert err.value.code == code
    assert ReadSession(e, ["both", "plain"], external="observe").report.external == ["plain"]
    assert read_once(e, "select 1 as one")[1].established == "snapshot" and read_once(e, "select * from both")[1].established == "observed"
    assert read_once(e, "select * from both", "snapshot")[0].count() == 2


def test_equivalence_checker(spark):
    from marlstone.conformance import check_equivalence

    one, two, three = Engine(spark), Engine(spark), Engine(spark)
    rows = [(1, "a"), (2, "b"), (2, "b")]
    one.register("t", spark.createDataFrame(rows, "id bigint, v string"))
    two.register("t", spark.createDataFrame(rows[::-1], "id bigint, v string"))
    three.register("t", spark.createDataFrame(rows[:2], "id bigint, v string"))
    check_equivalence(one, two, ["select * from t", "select id, count(*) as n from t group by id order by id", "select * from t order by id limit 2"])
    for code, other, sql in [("conformance_rows", three, "select * from t"), ("conformance_rows", three, "select id from t order by id"), ("conformance_rows", three, "select count(*) as n from t")]:
        with pytest.raises(CompileError) as e:
            check_equivalence(one, other, [sql])
        assert e.value.code == code
    three.register("t", spark.createDataFrame([(1, "a")], "id int, v string"))
    with pytest.raises(CompileError) as e:
        check_equivalence(one, three, ["select id from t"])
    assert e.value.code == "conformance_schema"


def test_verifier(spark, engine):
    from dataclasses import replace

    from pyspark.sql import types as T

    from marlstone.plans.verify import verify

    bound = engine.rows(item(a=Q.project("id"), b=Q.project("label")))
    verify(bound, engine.catalog.current)
    good = list(bound.slots)
    for code, change in [("plan_output", lambda b: setattr(b, "slots", [replace(good[0], type=T.StringType()), good[1]])), ("plan_relations", lambda b: setattr(b, "relations", set())), ("plan_shape", lambda b: setattr(b, "frame", b.frame.mapInArrow(lambda it: it, b.frame.schema)))]:
        broken = engine.rows(item(a=Q.project("id"), b=Q.project("label")))
        change(broken)
        with pytest.raises(CompileError) as e:
            verify(broken, engine.catalog.current)
        assert e.value.code == code


def test_prepared_sql(spark, engine):
    p = engine.prepare_sql("select id, $2 as tag from items where score >= $1 and active = $3", ["int64", "utf8", "boolean"])
    assert p.describe() == {"parameters": ["int64", "utf8", "boolean"], "columns": [("id", "bigint"), ("tag", "string")]}
    assert rows_of(p.bind([10, "it's", True])) == [(1, "it's"), (5, "it's")] and rows_of(p.bind([None, "x", True])) == []
    for code, call in [
        ("parameter_type", lambda: p.bind(["10", "x", True])), ("parameter_type", lambda: p.bind([True, "x", True])), ("parameter_count", lambda: p.bind([1])), ("parameter_type", lambda: engine.prepare_sql("select $1", ["uuid"])),
        ("parameter_count", lambda: engine.prepare_sql("select $2 from items", ["int64"])), ("unknown_relation", lambda: engine.prepare_sql("select $1 from nope", ["int64"])),
    ]:
        with pytest.raises(CompileError) as e:
            call()
        assert e.value.code == code
    made = engine.plan_sql("select count(*) as n from items")
    assert made["relations"] == ["items"] and made["columns"] == [("n", "bigint")] and "Aggregate" in made["plan"]


def test_search_follows_publications():
    from pyspark.sql import types as T

    c = C.Catalog()
    table = lambda name, *fields, **more: C.Relation(name, T.StructType([T.StructField(f, T.LongType()) for f in fields]), **more)
    c.publish([table("orders", "order_id", "total", description="what customers bought"), table("customers", "customer_id", meaning=C.Meaning(metrics=(C.Metric("heads", "count", aliases=("customers",)),)))])
    assert c.search("customers")[0] == ("relation", "customers", 7.0) and ("metric", "customers.heads", 3.0) in c.search("customers") and ("relation", "orders", 1.0) in c.search("customers")
    c.publish([table("orders", "order_id")])
    assert [h[:2] for h in c.search("total")] == [] and [h[:2] for h in c.search("order_id")] == [("field", "orders.order_id")]
    assert c.search("nothing") == [] and len(c.search("customers orders order customer id", 2)) == 2


def test_results_are_held_to_their_schema(spark):
    from marlstone.sources.files import normalise_result

    df = spark.createDataFrame([("1", 2.0), ("7", None)], "a string, b double")
    strict = spark.createDataFrame([], "a bigint not null, b double").schema
    assert rows_of(normalise_result(df, strict)) == [(1, 2.0), (7, None)]
    for schema in ("a bigint, b double not null", "a boolean, b double"):
        e = Engine(spark)
        with pytest.raises(Exception):
            normalise_result(e.adopt(df), spark.createDataFrame([], schema).schema).collect()
    with pytest.raises(SourceError):
        normalise_result(df, spark.createDataFrame([], "b double, a string").schema)


def test_as_of_equals_brute_force(spark):
    from marlstone.operators.joins import as_of

    rng = random.Random(51)
    spans = [(rng.choice("ab"), a := rng.randint(0, 40), a + rng.randint(-1, 6), i) for i in range(60)] + [(None, 0, 50, 99), ("a", None, 3, 98), ("c", 5, 10, None)]
    facts = [(i, rng.choice(["a", "b", "c", "d", None]), rng.randint(0, 45)) for i in range(200)]
    right = spark.createDataFrame(spans, "key string, since int, until int, mark int")

    def matches(k, t):
        return [m for key, a, b, m in spans if key is not None and key == k and a is not None and a <= t < b]

    clear = [f for f in facts if len(matches(*f[1:])) < 2]
    assert 40 < len(clear) < 200
    left = spark.createDataFrame(clear, "id int, k string, t int")
    ask = lambda df, **more: as_of(df, right, [("k", "key")], "t", "since", "until", {"found": "mark"}, **more)
    assert rows_of(ask(left)) == sorted(((i, k, t, next(iter(matches(k, t)), None)) for i, k, t in clear), key=str)
    assert rows_of(ask(left, missing="exclude")) == sorted(((i, k, t, matches(k, t)[0]) for i, k, t in clear if matches(k, t)), key=str)
    one = spark.createDataFrame([f for f in clear if len(matches(*f[1:])) == 1], left.schema)
    assert ask(one, exactly_one=True).count() == one.count()
    with pytest.raises(Exception):
        ask(spark.createDataFrame([next(f for f in facts if len(matches(*f[1:])) > 1)], left.schema)).collect()
    with pytest.raises(Exception):
        ask(spark.createDataFrame([next(f for f in facts if not matches(*f[1:]))], left.schema), exactly_one=True).collect()


def test_graph_evidence_and_outcomes(engine):
    rows = item(a=Q.project("id"))
    rows["requirements"][0]["source_text"] = "ids"
    graph = Q.graph({"r": {"kind": "rows", "query": rows}, "f": {"kind": "filter", "input": "r", "predicate": Q.compare("", "gt", "int64", 2, {"slot": "a"})}}, "f", [{"slot": "a", "direction": "asc", "nulls": "last"}], 2)
    graph["nodes"][0]["source_text"], graph["nodes"][1]["source_text"] = "ids of items", "over 2"
    request = "two ids of items over 2, in order"
    at = lambda *words: [{"start": request.index(w), "end": request.index(w) + len(w)} for w in words]
    entries = [({"kind": "node", "node": "r"}, at("ids of items")), ({"kind": "leaf", "node": "r", "requirement": "a"}, at("ids")), ({"kind": "node", "node": "f"}, at("over 2")), ({"kind": "order", "index": 0}, at("in order")), ({"kind": "limit"}, at("two"))]

    def intent(entries, **more):
        return {"query": graph, "evidence": {"version": 1, "request_id": "r1", "original_request": request, "requirements": [{"target": t, "source_spans": s} for t, s in entries], "unresolved_alternatives": [], **more}}

    assert rows_of(engine.compile_with_evidence(intent(entries)).result()) == [(3,), (4,)]
    said = engine.outcome(intent(entries))
    assert said["status"] == "compiled" and said["columns"] == [["id", "bigint", None]]
    for code, bad in [
        ("request_coverage", entries[:-1]), ("request_coverage", [*entries, entries[0]]), ("request_span", [(entries[0][0], at("ids")), *entries[1:]]), ("request_coverage", [(entries[0][0], []), *entries[1:]]),
        ("request_span", [*entries[:-1], ({"kind": "limit"}, [{"start": 3, "end": 4}])]), ("request_coverage", [*entries[:-1], ({"kind": "output", "node": "f", "slot": "a"}, at("two"))]),
    ]:
        with pytest.raises(CompileError) as e:
            engine.compile_with_evidence(intent(bad))
        assert e.value.code == code
    assert engine.outcome(intent(entries, unresolved_alternatives=["which items"]))["status"] == "needs_clarification"
    assert engine.outcome(intent(entries, version=2))["code"] == "request_evidence"
    assert engine.outcome(item(a=Q.project("nope")))["code"] == "unknown_field" and engine.outcome(item(a=Q.project("id")))["relations"] == ["items"]


def test_compiled_proposals_are_kept_while_nothing_changes(spark, tmp_path):
    e = Engine(spark)
    schema = spark.createDataFrame([], "id bigint").schema
    t = Generations(e.spark, f"file://{tmp_path}/t")
    t.create(schema, ("id",))
    e.bind("items", t)
    e.register("src", spark.createDataFrame([(1,), (2,)], schema))
    q = Q.proposal("items", n=Q.agg("count", None, "n"))
    one = e.rows(q)
    assert e.rows(json.loads(json.dumps(q))).frame is one.frame and e.rows(q, allowed={"items"}).frame is not one.frame and e.rows(q, context=Q.AT).frame is not one.frame
    assert one.result().first().n == 0
    e.write("insert into items select * from src")
    assert e.rows(q).frame is not one.frame and e.rows(q).result().first().n == 2
    two = e.rows(q)
    e.register("more", spark.range(1))
    assert e.rows(q).frame is not two.frame
    p = Q.proposal("src", k=Q.project("id"), f=Q.where({"kind": "compare_parameter", "field": Q.fld("id"), "operator": "eq", "parameter": "p"}))
    assert [e.prepare(p, {"p": "int64"}).bind({"p": {"type": "int64", "value": v}}).result().first().id for v in (1, 2)] == [1, 2]
