"""python -m marlstone PROJECT sql TEXT | plan TEXT | repl | compile FILE | compile-prepared FILE | search TERMS | inspect | validate | serve [PORT]; python -m marlstone PROJECT init makes an empty project file"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from marlstone.plans.errors import CompileError
from marlstone.plans.replay import contract
from marlstone.project import Project


def run(engine, command: str, rest: list[str], out=print) -> int:
    """One command; 0 if it went well."""
    try:
        if command == "sql":
            for row in engine.sql(rest[0]).toLocalIterator():
                out(json.dumps(row.asDict(), default=str))
        elif command == "compile":
            query = json.load(open(rest[0]))
            out(json.dumps(contract((engine.graph if "nodes" in query else engine.rows)(query))))
        elif command == "compile-prepared":
            body = json.load(open(rest[0]))
            out(json.dumps(contract(engine.prepare(body["query"], body["contract"]).bind(body["values"]))))
        elif command == "plan":
            made = engine.plan_sql(rest[0])
            out(json.dumps({k: made[k] for k in ("relations", "below", "columns")}))
            out(made["plan"])
        elif command == "search":
            for kind, name, weight in engine.catalog.search(" ".join(rest)):
                out(f"{kind} {name} {weight:g}")
        elif command == "inspect":
            for r in engine.tables().orderBy("table_name", "ordinal").toLocalIterator():
                out(f"{r.table_name}.{r.column_name}: {r.data_type}")
        elif command == "validate":
            out(f"{len(engine.catalog.current.relations)} relations, snapshot {engine.catalog.current.id}")
        elif command == "repl":
            while line := sys.stdin.readline():
                if line.strip() in (":quit", ":q"):
                    break
                if line.strip():
                    run(engine, "sql", [line.strip().rstrip(";")], out)
        elif command == "serve":
            from marlstone.serve import serve

            serve(engine, int(rest[0]) if rest else 5545).serve_forever()
        else:
            out(__doc__)
            return 2
    except CompileError as e:
        out(f"refused: {e}")
        return 1
    return 0


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    if args[1] == "init":
        with open(args[0], "x", encoding="utf-8") as f:
            json.dump({"sources": {}, "views": {}}, f, indent=1)
        return 0
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    return run(Project(args[0]).load(spark), args[1], args[2:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
