"""Project files, model documents, interpreter, replay, HTTP, command line, paged sources, streamed results."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from marlstone import queries as Q
from marlstone.__main__ import run
from marlstone.interpret import Scripted, interpret
from marlstone.plans import imports
from marlstone.plans.errors import CompileError
from marlstone.plans.replay import capture, replay
from marlstone.project import Project
from marlstone.serve import serve
from marlstone.sources.files import SourceError
from marlstone.sources.generations import WriteError
from marlstone.sources.paged import paged
from marlstone.sources.staging import staged
from marlstone.streaming.results import stream

MODEL = """
semantic_model:
  - name: wells
    datasets:
      - name: wells
        source: raw_wells
        primary_key: [well]
        fields:
          - {name: well, expression: {dialects: [{dialect: ANSI_SQL, expression: '"Well ID"'}]}, datatype: Integer}
          - {name: basin, expression: {dialects: [{dialect: ANSI_SQL, expression: basin}]}, datatype: String}
          - {name: depth, expression: {dialects: [{dialect: ANSI_SQL, expression: depth}]}}
    metrics:
      - {name: total_depth, expression: {dialects: [{dialect: ANSI_SQL, expression: SUM(depth)}]}, synonyms: [metres]}
    custom_extensions:
      - {dataset: wells, kind: concept, name: deep, predicate: {kind: compare, field: depth, operator: gt, value: {type: int64, value: 20}}}
      - {dataset: wells, kind: field_unit, field: depth, unit: m}
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "wells.csv").write_text("Well ID,basin,depth\n1,A,10\n2,A,30\n3,B,50\n")
    (tmp_path / "model.yaml").write_text(MODEL)
    (tmp_path / "deep.sql").write_text("select * from wells where depth > 20")
    (tmp_path / "deepest.sql").write_text("select max(depth) as most from deep")
    config = {"model_file": "model.yaml", "cache": {"folder": str(tmp_path / "cache")}, "sources": {"raw_wells": {"path": "wells.csv"}}, "views": {"deepest": {"sql_file": "deepest.sql", "max_age_seconds": 60}, "deep": {"sql_file": "deep.sql"}}}
    (tmp_path / "project.json").write_text(json.dumps(config))
    return tmp_path


def test_project_and_commands(spark, folder):
    pytest.importorskip("yaml")
    e = Project(str(folder / "project.json")).load(spark)
    q = Q.proposal("wells", c={"kind": "concept_filter", "concept": "deep"}, g=Q.group("basin"), m={"kind": "metric", "name": "metres", "alias": "total"})
    bad = json.loads(json.dumps(q))
    bad["requirements"][0]["operation"]["concept"] = "shallow"
    e_long = e.catalog.current.relation("wells").schema["depth"].dataType.simpleString()
    if e_long == "int":  # inferred widths are those of the data; the concept's literal must fit
        e.register("wells", e.spark.table("wells").selectExpr("cast(well as bigint) as well", "basin", "cast(depth as bigint) as depth"), e.catalog.current.relation("wells").meaning)
    assert sorted(map(tuple, e.rows(q).result().collect())) == [("A", 30), ("B", 50)]
    said: list[str] = []
    assert run(e, "sql", ["select most from deepest"], said.append) == 0 and json.loads(said[-1]) == {"most": 50}
    assert run(e, "sql", ["drop table wells"], said.append) == 1 and run(e, "nonsense", [], said.append) == 2
    (folder / "q.json").write_text(json.dumps(q))
    assert run(e, "compile", [str(folder / "q.json")], said.append) == 0 and json.loads(said[-1])[1] == ["total", "bigint", None]
    (folder / "p.json").write_text(json.dumps({"query": Q.proposal("wells", k=Q.project("well"), f=Q.where({"kind": "compare_parameter", "field": Q.fld("basin"), "operator": "eq", "parameter": "b"})), "contract": {"b": "utf8"}, "values": {"b": {"type": "utf8", "value": "A"}}}))
    assert run(e, "compile-prepared", [str(folder / "p.json")], said.append) == 0 and json.loads(said[-1])[0][0] == "well"
    assert run(e, "plan", ["select count(*) as n from deep"], said.append) == 0 and json.loads(said[-2])["relations"] == ["deep"]
    assert run(e, "search", ["metres"], said.append) == 0 and said[-1].startswith("metric wells.total_depth")
    assert run(e, "inspect", [], said.append) == 0 and run(e, "validate", [], said.append) == 0

    answer = interpret(e, "total metres of deep wells", Scripted([{"status": "query", "query": bad}, {"status": "query", "query": q}]))
    assert answer.outcome == "compiled" and answer.attempts == 2
    assert interpret(e, "x", Scripted([{"status": "query", "query": bad}] * 3)).outcome == "rejected"
    assert interpret(e, "x", Scripted([{"status": "needs_clarification", "question": "which?"}])).message == "which?"
    assert interpret(e, "x", Scripted([{"odd": 1}])).outcome == "provider_failure"

    record = json.loads(json.dumps(capture(e, q, e.rows(q))))
    assert replay(e, record).result().count() == 2
    with pytest.raises(CompileError) as err:
        replay(e, record | {"relations": []})
    assert err.value.code == "replay_capture_invalid"
    e.view("more", "select 1 as one")
    with pytest.raises(CompileError) as err:
        replay(e, record)
    assert err.value.code == "snapshot_mismatch"

    server = serve(e, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(path, body):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode(), method="POST")) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as x:
            return x.code, json.load(x)

    assert json.load(urllib.request.urlopen(base + "/health"))["ready"]
    assert "deep" in json.load(urllib.request.urlopen(base + "/catalog"))["relations"]
    assert post("/v1/compile/query", q)[1]["status"] == "compiled"
    assert post("/v1/compile/query", bad)[0:1] == (422,) and post("/v1/compile/query", bad)[1]["code"] == "unknown_concept"
    assert post("/sql", {"sql": "select count(*) as n from deep"})[1]["rows"] == [[2]]
    assert post("/compile", q)[1]["status"] == "compiled" and post("/compile", bad)[0] == 422
    assert post("/v1/plan/sql", {"sql": "select * from deep"})[1]["below"] and post("/v1/search", {"terms": "basin"})[1]["hits"][0]["kind"] == "field"
    assert post("/v1/describe/sql", {"sql": "select basin from deep where depth > $1", "types": ["int64"]})[1]["columns"] == [["basin", "string"]]
    assert post("/sql", {"sql": "select reflect('java.lang.Math', 'random') as r from deep"})[0] == 422
    assert post("/sql", {"sql": "x" * 20000})[0] == 413 and post("/none", {})[0] == 404
    server.shutdown()


def test_model_documents(spark):
    one = lambda **more: {"semantic_model": [{"name": "m", "datasets": [{"name": "d", "source": "s", "fields": [{"name": "a", "expression": {"dialects": [{"dialect": "ANSI_SQL", "expression": "a"}]}}]}], **more}]}
    assert [d.name for d in imports.inspect(one())] == ["d"]
    for code, doc in [
        ("schema", {}), ("model_selection", {"semantic_model": [{"name": "a"}, {"name": "b"}]}), ("unsupported_metric", one(metrics=[{"name": "x", "expression": {"dialects": [{"dialect": "ANSI_SQL", "expression": "SUM(a*2)"}]}}])),
        ("invalid_extension", one(custom_extensions=[{"dataset": "d", "kind": "odd"}])), ("schema", one(strange=1)), ("unsupported_relationship", one(relationships=[{"name": "r"}])),
    ]:
        with pytest.raises(imports.ImportError_) as e:
            imports.inspect(doc)
        assert e.value.problems[0][0] == code
    with pytest.raises(imports.ImportError_):
        imports.parse('{"a": 1, "a": 2}')
    from marlstone.session import Engine

    for code, bindings in [("missing_binding", {}), ("missing_column", {"s": spark.range(1)})]:
        with pytest.raises(imports.ImportError_) as e:
            imports.load(Engine(spark), one(), bindings)
        assert e.value.problems[0][0] == code


def test_project_refusals(tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"odd": 1}))
    with pytest.raises(SourceError):
        Project(str(tmp_path / "p.json"))
    (tmp_path / "p.json").write_text(json.dumps({"sources": {"s": {"connection": "none"}}}))
    with pytest.raises(SourceError):
        Project(str(tmp_path / "p.json"))


def test_paged_source(spark):
    def fetch(repository, equal, cursor):
        rows = [(repository, i, "open" if i % 2 else "closed") for i in range(5)]
        rows = [r for r in rows if equal.get("state", r[2]) == r[2]]
        at = int(cursor or 0)
        return rows[at : at + 2], str(at + 2) if at + 2 < len(rows) else None

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged("issues", fetch, "repository string, number int, state string", "repository", ["a", "b"], ("state",)))
    df = spark.read.format("issues").load()
    assert df.count() == 10
    assert sorted(r.number for r in df.where("repository = 'b' and state = 'open'").collect()) == [1, 3]


def test_streamed_results_and_staging(spark):
    batches, report = stream(spark.range(10), 4)
    assert [len(b) for b in batches] == [4, 4, 2] and report.complete and report.rows == 10
    with staged(spark.range(3), 5) as kept:
        assert kept.count() == 3
    with pytest.raises(WriteError), staged(spark.range(9), 5):
        pass
