"""Tools, pages and the command line over a small project."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from weftgraph import __main__ as cli
from weftgraph import surfaces
from weftgraph.index import Index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "a.py").write_text("def top():\n    return mid()\n\ndef mid():\n    return low()\n\ndef low():\n    return 1\n\ndef test_top():\n    top()\n")
    index = Index(spark, root)
    index.build()
    return index


def test_tools(index):
    ask = lambda method, more=(), **params: surfaces.answer(index, {"id": 1, "method": method, "params": params}, more)
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["explore"]
    assert len(ask("tools/list", surfaces.TOOLS)["result"]["tools"]) == 12
    assert "error" in ask("tools/call", name="arch") and "error" in ask("nothing")
    assert surfaces.answer(index, {"method": "notifications/initialized"}) is None
    given = {"explore": {"query": "mid"}, "search": {"query": "mid"}, "node": {"symbol": "mid"}, "callers": {"symbol": "mid"}, "callees": {"symbol": "mid"}, "impact": {"symbol": "low"}, "path": {"from": "top", "to": "low"}, "status": {}, "files": {}, "context": {"query": "mid"}, "tests": {"symbol": "low"}, "arch": {}}
    said = {}
    for name, arguments in given.items():
        result = ask("tools/call", surfaces.TOOLS, name=name, arguments=arguments)["result"]
        assert not result["isError"], (name, result)
        said[name] = result["content"][0]["text"]
    assert "def mid" in said["explore"] and "top" in said["callers"] and "low" in said["callees"] and "test_top" in said["tests"]
    assert said["path"].count("->") == 2 and said["files"] == "a.py" and "hotspots" in said["arch"]
    assert ask("tools/call", surfaces.TOOLS, name="search", arguments={"query": ""})["result"]["isError"]
    out = io.StringIO()
    surfaces.serve_tools(index, (), io.StringIO('{"id": 7, "method": "initialize"}\nnot json\n\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [7, None]


def test_pages(index):
    server = surfaces.serve_pages(index, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}").read())
    ids = {n["name"]: n["id"] for n in get("/api/graph")["nodes"]}
    assert get("/api/stats")["files"] == 1 and get("/api/search?q=mid")[0]["name"] == "mid"
    assert get(f"/api/node/{ids['mid']}")["callers"] == [ids["top"]]
    assert get("/api/cycles") == [] and len(get(f"/api/impact?id={ids['low']}")) == 3
    assert get(f"/api/path?from={ids['top']}&to={ids['low']}") == [ids["top"], ids["mid"], ids["low"]]
    assert b"weftgraph" in urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/").read()
    for path, code in (("/nothing", 404), ("/api/impact", 400), ("/api/node/none", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == code
    server.shutdown()


def test_commands(index):
    run = lambda *argv: cli.run(index, cli.parser().parse_args(argv))
    shown = lambda *argv: cli.shown(run(*argv))
    assert json.loads(shown("sync"))["indexed"] == 0
    assert json.loads(shown("status", "--health"))["parse_issues"] == []
    for argv in (("query", "mid"), ("node", "mid"), ("callers", "mid", "--limit", "3"), ("callees", "mid"), ("impact", "low"), ("tests", "low"), ("context", "mid", "--budget", "100"), ("files",), ("definition", str(index.root) + "/a.py", "2", "14"), ("arch",)):
        assert json.loads(shown(*argv)), argv
    assert json.loads(shown("path", "top", "low"))["path"][-1].endswith("low")
    assert run("export", "--format", "dot").startswith("digraph")
