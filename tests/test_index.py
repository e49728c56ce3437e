"""A project from files to answers: resolution tiers, refresh, removal, streaming, exports."""

import json
import subprocess

import pytest

from weftgraph.index import Index
from weftgraph.sources import export
from weftgraph.streaming import service


def project(tmp_path, **files):
    for name, text in files.items():
        path = tmp_path / name.replace("__", "/").replace("_rs", ".rs").replace("_py", ".py").replace("_java", ".java")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def callees(index, name):
    return sorted(r["qualified_name"].rsplit("/", 1)[-1] for r in index.callees(name).collect())


def test_qualified_calls_go_to_their_types_and_unknown_types_nowhere(spark, tmp_path):
    root = project(
        tmp_path,
        db_rs="pub struct Db;\nimpl Db { pub fn open() {} }\npub struct Connection;\nimpl Connection { pub fn open() {} }\nfn run() { Db::open(); Connection::open(); }\n",
        w_rs="pub struct Widget;\nimpl Widget { pub fn new() {} }\nfn build() { Vec::new(); }\n",
    )
    index = Index(spark, root)
    stats = index.build()
    assert stats["indexed"] == 2 and stats["files"] == 2
    assert callees(index, "run") == ["db.rs::impl Connection::open", "db.rs::impl Db::open"]
    assert callees(index, "build") == []


def test_tiers_refresh_and_removal(spark, tmp_path):
    root = project(
        tmp_path,
        b_py="def init():\n    pass\n\ndef helper():\n    return init()\n",
        c_py="def init():\n    pass\n",
        a_py="from b import init\n\ndef go():\n    init()\n    helper()\n",
    )
    index = Index(spark, root)
    index.build()
    assert callees(index, "go") == ["b.py::helper", "b.py::init"]  # narrowed by the import
    assert callees(index, "helper") == ["b.py::init"]  # the same file
    assert index.build()["indexed"] == 0
    (root / "b.py").write_text("def init():\n    pass\n\ndef helper2():\n    return init()\n")
    assert index.build()["indexed"] == 1
    assert callees(index, "go") == ["b.py::init"]
    (root / "c.py").unlink()
    done = index.build()
    assert done["removed"] == 1 and done["files"] == 2
    assert index.build(force=True)["indexed"] == 2
    assert index.find("init").count() == 1


def test_incremental_equals_full(spark, tmp_path):
    root = project(tmp_path, b_py="def helper():\n    pass\n", a_py="def go():\n    helper()\n    other()\n", d_py="def other():\n    go()\n")
    index = Index(spark, root)
    index.build()
    (root / "b.py").write_text("def helper():\n    go()\n\ndef more():\n    helper()\n")
    (root / "d.py").unlink()
    updated, removed = service.pending(index)
    index.apply_changes(updated, removed)
    step = {tuple(r) for r in index.store.read("derived").select("source", "target", "kind", "confidence").collect()}
    index.build(force=True)
    full = {tuple(r) for r in index.store.read("derived").select("source", "target", "kind", "confidence").collect()}
    assert step == full and step


def test_watch_applies_changes(spark, tmp_path):
    root = project(tmp_path / "p", a_py="def one():\n    pass\n")
    index = Index(spark, root)
    index.build()
    (root / "a.py").write_text("def two():\n    pass\n")
    query = service.watch(index, once=True, checkpoint=str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    assert index.find("two").count() == 1 and index.find("one").count() == 0


def test_questions_and_exports(spark, tmp_path):
    root = project(
        tmp_path,
        src__core_py="def validate_token(x):\n    '''Checks a token.'''\n    return load_user(x)\n\ndef load_user(x):\n    return x\n",
        tests__test_core_py="def test_validate():\n    validate_token(1)\n",
        src__ping_rs="fn ping() { pong(); }\nfn pong() { ping(); }\nfn lonely() {}\n",
    )
    index = Index(spark, root)
    index.build()
    assert index.query("validate token").first()["name"] == "validate_token"
    assert index.query("validte tokn").first()["name"] in ("validate_token", "test_validate")
    assert [p.rsplit("::", 1)[1] for p in index.path("test_validate", "load_user")] == ["test_validate", "validate_token", "load_user"]
    assert index.path("load_user", "test_validate") is None
    assert [r["name"] for r in index.tests("load_user").collect()] == ["test_validate"]
    assert {r["name"]: r["depth"] for r in index.impact("load_user").collect()} == {"validate_token": 1, "test_validate": 2}
    arch = index.arch()
    assert arch["cycles"].count() == 2
    assert [r["name"] for r in arch["orphans"].collect()] == ["lonely"]
    assert {r["layer"] for r in arch["layers"].collect()} == {"src", "tests"}
    packed = index.context("validate token", 8000).collect()
    assert {"validate_token", "load_user"} <= {r["header"].split("::")[-1].split()[0] for r in packed}
    assert len(index.context("validate token", 1).collect()) == 1
    explored = index.explore("validate")["symbols"].collect()
    assert explored[0]["lines"][0]["text"].startswith("def")
    assert index.status(True)["files"] == 3
    assert index.tree(1).count() == 3

    told = json.loads(index.export("json"))
    assert any(n["name"] == "validate_token" for n in told["nodes"]) and any(e["kind"] == "calls" for e in told["edges"])
    assert index.export("dot").startswith("digraph") and "->" in index.export("dot")
    nodes, edges = export.read_csv_sections(index.export("csv"))
    assert len(nodes) == index.nodes().count() and len(edges) == index.edges().count()
    lsif = [json.loads(line) for line in index.export("lsif").splitlines()]
    assert lsif[0]["label"] == "metaData" and len({x["id"] for x in lsif}) == len(lsif)
    with pytest.raises(ValueError):
        index.export("xml")
    assert index.remove() and not index.remove()


def test_git_cochange_and_diff(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(3):
        (tmp_path / "a.py").write_text(f"def a():\n    return {k}\n")
        (tmp_path / "b.py").write_text(f"def b():\n    a()\n    return {k}\n")
        git("add", "-A")
        git("commit", "-q", "-m", "x")
    index = Index(spark, tmp_path)
    index.build()
    assert [tuple(r) for r in index.cochange(3).collect()] == [("a.py", "b.py", 3, 1.0)]
    (tmp_path / "a.py").write_text("def a():\n    return 9\n")
    touched, reached = index.diff()
    assert [r["name"] for r in touched.collect()] == ["a"]
    assert reached.count() == 1
