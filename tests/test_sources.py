"""Scans, configuration, logs, diffs, lines, pages, exports, the store and streams."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import config, export, gitlog, lines, scan, store, web
from weftgraph.streaming import watch


def test_config(tmp_path, caplog):
    assert config.Config.load(tmp_path) == config.Config()
    (tmp_path / config.FILE).write_text(json.dumps({"max_file_size": 2048, "disabled_languages": ["scheme"]}))
    told = config.Config.load(tmp_path)
    assert told.max_file_size == 2048 and not told.enabled("scheme") and told.enabled("rust")
    for bad in ("{", '{"unknown": 1}', "[]"):
        (tmp_path / config.FILE).write_text(bad)
        assert config.Config.load(tmp_path) == config.Config()


def test_scan(spark, tmp_path):
    root, extra = tmp_path / "p", tmp_path / "extra"
    for path, text in {"src/main.rs": "fn main() {}", ".hidden/x.py": "x = 1", "target/y.rs": "fn y() {}", "generated/api.rs": "fn a() {}", "keep.gen.rs": "fn k() {}", "README.md": "", "big.rs": "x" * 5000, "a.h": "class X {};", "lib.scm": "(define x 1)"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    extra.mkdir()
    (extra / "e.go").write_text("package e")
    (root / ".gitignore").write_text("# c\n*.gen.rs\n!keep.gen.rs\n")
    (root / ".weftgraphignore").write_text("generated/\n")
    (root / config.FILE).write_text(json.dumps({"max_file_size": 2000, "disabled_languages": ["scheme"], "extra_roots": ["../extra", "../none", "src"]}))
    got = {r["path"].split("/")[-1]: r["language"] for r in scan.scan(spark, str(root)).collect()}
    assert got == {"main.rs": "rust", "x.py": "python", "keep.gen.rs": "rust", "a.h": "cpp", "e.go": "go"}


@pytest.mark.parametrize("pattern,path,hit", [("generated/", "generated/api.rs", True), ("generated/", "x/generated/api.rs", True), ("/top.rs", "top.rs", True), ("/top.rs", "x/top.rs", False), ("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("a/*.rs", "a/b/c.rs", False), ("a/**/c.rs", "a/b/c.rs", True)])
def test_ignore_patterns(spark, pattern, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(scan.ignore_regex(pattern))).first()[0] is hit


def test_logs_and_hunks(spark):
    text = "@abc123\nsrc/a.rs\nsrc/b.rs\n\n@def456\nsrc/a.rs\n"
    frame = spark.createDataFrame([(0, k, x) for k, x in enumerate(text.split("\n"))], "log bigint, line_no bigint, text string")
    got = sorted((r["commit"], r["file"]) for r in gitlog.parse_log(frame).collect())
    assert got == [("abc123", "src/a.rs"), ("abc123", "src/b.rs"), ("def456", "src/a.rs")]
    hunks = spark.createDataFrame([("a", "@@ -1,2 +10,3 @@ fn"), ("b", "@@ -1 +5 @@"), ("c", "@@ -4,2 +7,0 @@"), ("d", "nothing")], "file_path string, header string")
    got = {}
    for r in gitlog.changed_lines(hunks).collect():
        got.setdefault(r["file_path"], set()).add(r["line"])
    assert got == {"a": {10, 11, 12}, "b": {5}, "c": {7}}


def test_line_slices(spark):
    cut = lambda text, a, b: spark.range(1).select(lines.slice_lines(F.lit(text), F.lit(a), F.lit(b))).first()[0]
    assert cut("line1\nline2\nline3\n", 1, 2) == ["line1", "line2"]
    assert cut("x\ny\n", 10, 12) == [] and cut("x\ny", 2, 9) == ["y"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://h.org/a/b?q#f", '<a href="/x"></a><a href="c.html"></a><a href="https://o.org/">z</a><script>one</script>\n<SCRIPT type="x">two</script>')], "page_id bigint, url string, html string")
    assert {r["target"] for r in web.links(df).collect()} == {"http://h.org/x", "http://h.org/a/c.html", "https://o.org/"}
    assert [r["body"] for r in web.script_blocks(df).orderBy("block").collect()] == ["one", "two"]


def test_store_commits_all_or_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        s.read("nodes")
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    assert s.commit({"nodes": frame(1), "edges": frame(7)}) == 1
    assert s.commit({"nodes": frame(2, 3)}, batch=5) == 2
    assert s.read("nodes").count() == 2 and s.read("edges").count() == 1
    assert s.commit({"nodes": frame()}, batch=5) == 2  # delivered again
    broken = frame(1).select(F.raise_error(F.lit("no")).alias("v"))
    with pytest.raises(Exception):
        s.commit({"nodes": broken})
    assert s.version() == 2 and s.read("nodes").count() == 2
    assert s.remove() and s.version() is None


def test_csv_fields(spark):
    field = lambda x: spark.range(1).select(export.csv_field(F.lit(x))).first()[0]
    assert [field(x) for x in ("a b", 'say "x"', "a,b", "l\nm")] == ["a b", '"say ""x"""', '"a,b"', '"l\nm"']


def test_change_streams(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    records = [("/p/src/main.rs", "update", "2024-01-01T00:00:00"), ("/p/src/main.rs", "remove", "2024-01-01T00:00:01"), ("/p/a.py", "update", "2024-01-01T00:00:01"), ("/p/target/debug/main.rs", "update", "2024-01-01T00:00:00"), ("/p/README.md", "update", "2024-01-01T00:00:00")]
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "op", "ts"), r))) for r in records))

    def apply(updated, removed, batch_id):
        seen.append(([r["path"] for r in updated.collect()], [r["path"] for r in removed.collect()], batch_id))
        raise RuntimeError("the stream goes on")

    query = watch.maintain(watch.watch_changes(spark, str(folder)), apply, str(tmp_path / "cp"), {"availableNow": True})
    assert query.awaitTermination(120) and query.exception() is None
    assert seen == [(["/p/a.py"], ["/p/src/main.rs"], 0)]


def test_debounce_in_batch(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:01")]
    df = spark.createDataFrame([(p, t, k) for k, (p, t) in enumerate(rows)], "path string, ts string, event_id int").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["path"], r["n"]) for r in watch.debounced(df).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r["path"], r["n"]) for r in watch.islands(df).collect()) == [("a", 1), ("a", 2), ("b", 1)]
