"""A small HTTP front: health, catalog, compilation of typed queries, and read-only SQL."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from marlstone.plans.errors import CompileError
from marlstone.plans.replay import contract

MOST_BYTES, MOST_ROWS = 16 * 1024, 10_000


def handler(engine, concurrent: int = 4):
    """A request handler over an engine; beyond ``concurrent`` compilations at a time, requests get 429."""
    admission = threading.Semaphore(concurrent)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def reply(self, status: int, body) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/health":
                self.reply(200, {"ready": True})
            elif self.path == "/catalog":
                s = engine.catalog.current
                self.reply(200, {"snapshot": s.id, "relations": {n: {"kind": r.kind, "fields": {f.name: f.dataType.simpleString() for f in r.schema}, "metrics": [m.id for m in r.meaning.metrics]} for n, r in s.relations.items()}})
            else:
                self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                return self.reply(413, {"error": "too large"})
            try:
                body = json.loads(self.rfile.read(size))
            except ValueError:
                return self.reply(400, {"error": "not JSON"})
            if not admission.acquire(blocking=False):
                return self.reply(429, {"error": "busy"})
            try:
                made = {
                    "/v1/compile/query": lambda: engine.rows(body), "/v1/compile/graph": lambda: engine.graph(body), **dict.fromkeys(("/v1/compile/intent", "/v1/compile/graph-intent"), lambda: engine.compile_with_evidence(body)),
                    "/v1/compile/prepared-row": lambda: engine.prepare(body["query"], body["contract"]).bind(body["values"]),
                }
                if self.path == "/compile":
                    said = engine.outcome(body)
                    self.reply(200 if said["status"] == "compiled" else 422, said)
                elif self.path in made:
                    bound = made[self.path]()
                    self.reply(200, {"status": "compiled", "snapshot": engine.catalog.current.id, "columns": contract(bound), "relations": sorted(bound.relations)})
                elif self.path == "/v1/plan/sql":
                    self.reply(200, engine.plan_sql(body["sql"]))
                elif self.path == "/v1/describe/sql":
                    self.reply(200, engine.prepare_sql(body["sql"], body["types"]).describe())
                elif self.path == "/v1/search":
                    self.reply(200, {"hits": [{"kind": k, "name": n, "weight": w} for k, n, w in engine.catalog.search(body["terms"], body.get("limit", 64))]})
                elif self.path == "/sql":
                    df = engine.sql(body["sql"], body.get("parameters"))
                    rows = df.limit(MOST_ROWS + 1).collect()
                    self.reply(200, {"columns": df.columns, "rows": [list(r) for r in rows[:MOST_ROWS]], "complete": len(rows) <= MOST_ROWS})
                else:
                    self.reply(404, {"error": "not found"})
            except CompileError as e:
                self.reply(422, {"status": "rejected", "code": e.code, "requirement": e.requirement, "message": str(e)})
            except (KeyError, TypeError, AttributeError) as e:
                self.reply(400, {"error": repr(e)})
            finally:
                admission.release()

    return Handler


def serve(engine, port: int = 5545, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(engine))
