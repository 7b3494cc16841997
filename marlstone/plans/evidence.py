"""Evidence: every requirement of a query, or part of a graph, points at the bytes of the request that it comes from."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from marlstone.plans.errors import CompileError
from marlstone.plans.literals import take

MOST_PARTS, MOST_BYTES = 512, 64 * 1024
#: Lists of outputs by kind of node (fixed values).
OUTPUTS = {
    "rows": (), "filter": (), "set": ("columns",), "compose": ("keys", "outputs"), "calculate": ("passthrough", "ratios"), "conditional": ("passthrough", "outputs"),
    "cast": ("passthrough", "casts"), "null_test": ("passthrough", "tests"), "compare_slots": ("passthrough", "comparisons"),
}


def header(evidence: Mapping, *names: str) -> tuple[bytes, list]:
    """The request's bytes, and what else is named."""
    if len(json.dumps(evidence, default=str)) > MOST_BYTES:
        raise CompileError("input_limit", "evidence")
    version, rid, request, alternatives, *rest = take(evidence, "version", "request_id", "original_request", "unresolved_alternatives", *names)
    if version != 1 or not rid.strip() or len(rid) > 256 or not request.strip():
        raise CompileError("request_evidence", "version 1, an identity and a text")
    if alternatives:
        raise CompileError("unresolved_alternatives", ", ".join(alternatives))
    return request.encode(), rest


def quoted(raw: bytes, spans: list, what: str) -> str:
    """The text that spans point at, joined by spaces; they are in order, apart, on whole characters and not blank."""
    if not spans:
        raise CompileError("request_coverage", what)
    out, end = [], 0
    for s in spans:
        a, b = take(s, "start", "end")
        if not end <= a < b <= len(raw):
            raise CompileError("request_span", what)
        try:
            raw[:a].decode()
            text = raw[a:b].decode()
        except UnicodeDecodeError:
            raise CompileError("request_span", what) from None
        if not text.strip():
            raise CompileError("request_span", what)
        out.append(text)
        end = b
    return " ".join(out)


def check(intent: Mapping) -> None:
    """Refuse a row query some of whose requirements lack spans, or whose source texts aren't what these say."""
    query, evidence = take(intent, "query", "evidence")
    raw, (spans,) = header(evidence, "requirement_spans")
    texts = {r["id"]: r["source_text"] for r in query["requirements"]}
    if set(spans) != set(texts):
        raise CompileError("request_coverage", "requirements and spans differ")
    for rid, own in spans.items():
        if quoted(raw, own, rid) != texts[rid]:
            raise CompileError("request_span", rid)


def parts(query: Mapping) -> Iterator[tuple[tuple, str | None]]:
    """Everything of a graph that needs evidence, and its source text if it has one: nodes, their rows' requirements, their outputs, the order's keys, the limit."""
    for n in query["nodes"]:
        nid, op = n["id"], n["operation"]
        yield ("node", nid), n["source_text"]
        kind = op.get("kind")
        if kind not in OUTPUTS:
            raise CompileError("invalid_requirement", str(kind))
        for r in op["query"]["requirements"] if kind == "rows" else ():
            yield ("leaf", nid, r["id"]), r["source_text"]
        for name in OUTPUTS[kind]:
            for o in op[name]:
                yield ("output", nid, o["id"]), None
    for i in range(len(query["ordering"])):
        yield ("order", i), None
    if query.get("limit") is not None:
        yield ("limit",), None


def target(t: Mapping) -> tuple:
    """What a piece of evidence is about, as ``parts`` names it."""
    named = {"node": ("node",), "leaf": ("node", "requirement"), "output": ("node", "slot"), "order": ("index",), "limit": ()}
    kind = t.get("kind")
    if kind not in named:
        raise CompileError("request_coverage", str(kind))
    return tuple(take(t, "kind", *named[kind])) if named[kind] else (take(t, "kind"),)


def check_graph(intent: Mapping) -> None:
    """Refuse a graph some of whose parts lack evidence, or have it twice, or whose source texts aren't what the spans say."""
    query, evidence = take(intent, "query", "evidence")
    raw, (entries,) = header(evidence, "requirements")
    wanted: dict[tuple, str | None] = {}
    for name, text in parts(query):
        if name in wanted:
            raise CompileError("request_coverage", "/".join(map(str, name)))
        wanted[name] = text
        if len(wanted) > MOST_PARTS:
            raise CompileError("work_limit", "graph requirements")
    if sum(len(e.get("source_spans", ())) for e in entries) > MOST_PARTS:
        raise CompileError("work_limit", "spans")
    for e in entries:
        about, spans = take(e, "target", "source_spans")
        name = target(about)
        what = "/".join(map(str, name))
        if name not in wanted:
            raise CompileError("request_coverage", what)
        text = wanted.pop(name)
        if quoted(raw, spans, what) != text and text is not None:
            raise CompileError("request_span", what)
    if wanted:
        raise CompileError("request_coverage", ", ".join("/".join(map(str, n)) for n in wanted))
