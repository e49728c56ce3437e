"""The index for other programs: named tools over stdio, pages of JSON over HTTP, and text reports."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph

BRIEF = ("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line")


def brief(df: DataFrame, *more: str) -> list[dict]:
    return [r.asDict() for r in df.select(*BRIEF, *more).collect()]


# text reports


def places(rows: Iterable[dict]) -> str:
    return "\n".join(f"- {r['kind']} {r['qualified_name']} ({r['file_path']}:{r['start_line']})" for r in rows) or "none"


def explore_text(index, query: str) -> str:
    """Hits by file with source lines, callers and callees, then the blast radius and stale files."""
    found = index.explore(query)
    out: list[str] = []
    named: dict[str, str] = {}
    rows = found["symbols"].collect()
    wanted = {i for r in rows for i in [*(r["callers"] or []), *(r["callees"] or [])]}
    if wanted:
        ids = index.spark.createDataFrame([(i,) for i in wanted], "id string")
        named = {r["id"]: r["qualified_name"] for r in index.nodes().join(F.broadcast(ids), "id", "left_semi").collect()}
    for path in sorted({r["file_path"] for r in rows}):
        out.append(f"## {path}")
        for r in (r for r in rows if r["file_path"] == path):
            out.append(f"### {r['kind']} {r['qualified_name']}")
            out += [f"{x['line']:>5} {x['text']}" for x in r["lines"] or []]
            for what in ("callers", "callees"):
                if r[what]:
                    out.append(f"{what}: " + ", ".join(named.get(i, i) for i in r[what]))
    out.append(f"blast radius: {found['blast_radius'].count()}")
    if stale := [r["path"] for r in index.stale().collect()]:
        out.append("changed since indexing: " + ", ".join(sorted(stale)))
    return "\n".join(out)


def context_text(index, query: str, budget: int) -> str:
    rows = index.context(query, budget).collect()
    return "\n\n".join(f"// {r['header']} [{r['reason']}]\n{r['body']}" for r in rows) + f"\n\n{sum(r['tokens'] for r in rows)} of {budget} tokens"


def arch_text(index) -> str:
    parts = {k: [r.asDict() for r in df.collect()] for k, df in index.arch().items()}
    rings: dict = {}
    for r in parts["cycles"]:
        rings.setdefault(r["component"], []).append(r["id"])
    lines = [f"cycles: {len(rings)}"] + [f"- {len(v)} symbols" for v in sorted(rings.values(), key=len, reverse=True)]
    for title, form in (("hotspots", "{id}: {fan_in} in, {fan_out} out"), ("orphans", "{qualified_name}"), ("layers", "{layer}: {symbols}"), ("coupling", "{from_layer} -> {to_layer}: {n}"), ("layer_cycles", "{from_layer} <-> {to_layer}")):
        lines += [f"{title}:"] + ["- " + form.format(**r) for r in parts[title]]
    return "\n".join(lines)


def diff_text(index, base: str = "HEAD", depth: int = 2) -> str:
    touched, reached = index.diff(base, depth)
    return f"changed:\n{places(brief(touched))}\nreached: {reached.select('id').distinct().count()}"


def cochange_text(index, least: int = 3) -> str:
    return "\n".join(f"- {r['a']} + {r['b']}: {r['together']} times, {r['confidence']:.0%}" for r in index.cochange(least).collect()) or "none"


# tools

ALWAYS = "explore"
TOOLS: dict[str, tuple[str, dict, Callable]] = {
    "explore": ("Symbols by full text, with source, call paths and blast radius", {"query": "string"}, lambda i, query: explore_text(i, query)),
    "search": ("Symbols by full text", {"query": "string", "kind": "string", "limit": "integer"}, lambda i, query, kind=None, limit=20: places(brief(i.nodes().join(i.full_text(query, kind, limit), "id").orderBy("score", "id")))),
    "node": ("Source and callers of a symbol", {"symbol": "string"}, lambda i, symbol: places(brief(i.find(symbol))) + "\ncallers:\n" + places(brief(i.callers(symbol)))),
    "callers": ("What calls a symbol", {"symbol": "string", "limit": "integer"}, lambda i, symbol, limit=20: places(brief(i.callers(symbol, limit)))),
    "callees": ("What a symbol calls", {"symbol": "string", "limit": "integer"}, lambda i, symbol, limit=20: places(brief(i.callees(symbol, limit)))),
    "impact": ("What a change of a symbol reaches", {"symbol": "string", "depth": "integer"}, lambda i, symbol, depth=5: places(brief(i.impact(symbol, depth)))),
    "path": ("A chain of calls between two symbols", {"from": "string", "to": "string"}, lambda i, **a: " -> ".join(i.path(a["from"], a["to"]) or ["none"])),
    "status": ("Numbers of the index", {}, lambda i: json.dumps(i.status())),
    "files": ("Indexed files", {}, lambda i: "\n".join(r["relative"] for r in i.tree(1 << 20).collect())),
    "context": ("A query's code within a budget of tokens", {"query": "string", "budget": "integer"}, lambda i, query, budget=8000: context_text(i, query, budget)),
    "tests": ("Tests that reach a symbol", {"symbol": "string", "depth": "integer"}, lambda i, symbol, depth=6: places(brief(i.tests(symbol, depth)))),
    "arch": ("Cycles, hotspots, orphans, layers and coupling", {}, lambda i: arch_text(i)),
}


def offered(more: Iterable[str] = ()) -> list[str]:
    """Tools a client may use: the first always, others if they were asked for."""
    return [ALWAYS, *(n for n in TOOLS if n in set(more) and n != ALWAYS)]


def answer(index, request: dict, more: Iterable[str] = ()) -> dict | None:
    """The reply to one JSON-RPC request (initialize, tools/list, tools/call); notifications have none."""
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    method, given = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "weftgraph", "version": "0.1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": TOOLS[n][0], "inputSchema": {"type": "object", "properties": {k: {"type": v} for k, v in TOOLS[n][1].items()}}} for n in offered(more)]}}
    if method == "tools/call":
        name = given.get("name")
        if name not in offered(more):
            return reply | {"error": {"code": -32602, "message": f"no such tool: {name}"}}
        try:
            text, wrong = TOOLS[name][2](index, **(given.get("arguments") or {})), False
        except Exception as e:
            text, wrong = str(e).split("\n")[0], True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": wrong}}
    return reply | {"error": {"code": -32601, "message": f"no such method: {method}"}}


def serve_tools(index, more: Iterable[str] = (), lines: IO = sys.stdin, out: IO = sys.stdout) -> None:
    for line in lines:
        if line.strip():
            try:
                reply = answer(index, json.loads(line), more)
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                print(json.dumps(reply), file=out, flush=True)


# pages


def page(index, path: str, query: dict[str, str]):
    """What a page shows as plain values, or None for an unknown one."""
    number = lambda name, default: int(query.get(name, default))
    if path == "/api/stats":
        return index.stats()
    if path == "/api/search":
        return brief(index.query(query.get("q", ""), query.get("kind"), number("limit", 30)))
    if path == "/api/graph":
        top, between = graph.top_subgraph(index.edges(), index.nodes(), number("limit", 150))
        return {"nodes": brief(top, "size"), "edges": [r.asDict() for r in between.select("source", "target", "kind").collect()]}
    if path.startswith("/api/node/"):
        id_ = unquote(path.removeprefix("/api/node/"))
        node = index.nodes().filter(F.col("id") == id_)
        if node.isEmpty():
            return None
        e, n = index.edges(), index.nodes()
        return brief(node)[0] | {"callers": [r["source"] for r in graph.callers(e.filter(F.col("target") == id_), n, 50).orderBy("position").collect()], "callees": [r["target"] for r in graph.callees(e.filter(F.col("source") == id_), n, 50).orderBy("position").collect()]}
    if path == "/api/cycles":
        rings: dict = {}
        for r in graph.cycles(index.edges()).collect():
            rings.setdefault(r["component"], []).append(r["id"])
        return sorted((sorted(v) for v in rings.values()), key=lambda v: (-len(v), v))
    if path == "/api/impact":
        seed = index.spark.createDataFrame([(query["id"],)], "id string")
        return sorted(r["id"] for r in graph.impact(index.edges(), seed, number("depth", 3), index.nodes()).select("id").distinct().collect())
    if path == "/api/path":
        return graph.call_path(index.edges(), query["from"], query["to"], index.nodes()) or []
    if path == "/":
        return "<!doctype html><title>weftgraph</title><h1>weftgraph</h1><p>See /api/stats, /api/search?q=, /api/graph, /api/node/ID, /api/cycles, /api/impact?id=, /api/path?from=&amp;to=</p>"
    return None


def serve_pages(index, port: int = 7878) -> ThreadingHTTPServer:
    """A server on this machine for :func:`page`; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            where = urlparse(self.path)
            try:
                value = page(index, where.path, {k: v[-1] for k, v in parse_qs(where.query).items()})
                status = 404 if value is None else 200
            except (KeyError, ValueError) as e:
                value, status = {"error": str(e)}, 400
            body = (value if where.path == "/" else json.dumps(value)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html" if where.path == "/" else "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
