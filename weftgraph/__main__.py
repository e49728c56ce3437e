"""Command line: ``python -m weftgraph COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .index import Index


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--root", default=".")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, **options) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(*a[:-1], **a[-1]) if isinstance(a[-1], dict) else c.add_argument(*a)
        for o, default in options.items():
            flag = "--" + o.replace("_", "-")
            c.add_argument(flag, action="store_true") if default is False else c.add_argument(flag, default=default, type=type(default) if default is not None else str)

    for name in ("init", "uninit", "sync", "arch", "watch"):
        command(name)
    command("index", force=False, quiet=False)
    command("status", health=False)
    command("query", ("text",), kind=None, limit=20)
    command("context", ("text",), budget=8000)
    command("tests", ("name",), depth=6)
    command("export", format="json")
    command("cochange", min=3, since=None)
    command("definition", ("file",), ("line", {"type": int}), ("column", {"type": int}))
    command("explore", ("text",))
    command("node", ("name",))
    command("callers", ("name",), limit=20)
    command("callees", ("name",), limit=20)
    command("path", ("source",), ("target",))
    command("impact", ("name",), depth=5)
    command("files", max_depth=3)
    command("serve", port=7878)
    command("mcp", tools="")
    command("diff", ("base", {"nargs": "?", "default": "HEAD"}), depth=2, tests=False)
    return p


def shown(value) -> str:
    """Frames, mappings of frames and plain values as JSON text."""
    plain = lambda v: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    return json.dumps(plain(value), indent=2, ensure_ascii=False, default=str)


def definition(index: Index, file: str, line: int, column: int) -> DataFrame:
    """Nodes that the word at a place of a file may mean, best resolved first."""
    from pathlib import Path

    text = Path(file).read_text(errors="replace").splitlines()[line - 1]
    start = end = max(0, column - 1)
    word = lambda c: c.isalnum() or c == "_"
    while start and word(text[start - 1]):
        start -= 1
    while end < len(text) and word(text[end]):
        end += 1
    return index.find(text[start:end]).orderBy("file_path", "start_line")


def run(index: Index, a: argparse.Namespace):
    c = a.command
    if c in ("init", "sync"):
        return index.build()
    if c == "index":
        return index.build(a.force)
    if c == "uninit":
        return {"removed": index.remove()}
    if c == "watch":
        from .streaming.service import watch

        index.build()
        return watch(index).awaitTermination() or ""
    if c == "serve":
        from .surfaces import serve_pages

        serve_pages(index, a.port).serve_forever()
    if c == "mcp":
        from .surfaces import serve_tools

        return serve_tools(index, a.tools.split(",")) or ""
    if c == "status":
        return index.status(a.health)
    if c == "query":
        return index.query(a.text, a.kind, a.limit)
    if c == "context":
        return index.context(a.text, a.budget)
    if c == "tests":
        return index.tests(a.name, a.depth)
    if c == "arch":
        return index.arch()
    if c == "export":
        return index.export(a.format)
    if c == "cochange":
        return index.cochange(a.min, a.since)
    if c == "definition":
        return definition(index, a.file, a.line, a.column)
    if c == "explore":
        return index.explore(a.text)
    if c == "node":
        return index.find(a.name)
    if c == "callers":
        return index.callers(a.name, a.limit)
    if c == "callees":
        return index.callees(a.name, a.limit)
    if c == "path":
        return {"path": index.path(a.source, a.target)}
    if c == "impact":
        return index.impact(a.name, a.depth)
    if c == "files":
        return index.tree(a.max_depth).select("relative", "language", "size")
    touched, reached = index.diff(a.base, a.depth)
    out = {"symbols": touched, "impact": reached}
    if a.tests:
        from .operators.analysis import related_tests

        out["tests"] = related_tests(index.edges(), index.nodes(), touched.select("id"))
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        value = run(Index(spark, a.root), a)
    except (FileNotFoundError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(value if isinstance(value, str) else shown(value))
    return 0


if __name__ == "__main__":
    sys.exit(main())
