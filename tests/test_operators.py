"""Graph, search, analysis, resolution, table, text and path operators on small fixtures."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.functions import text as t
from weftgraph.operators import analysis, context, graph, resolve, search, tables

EDGE = "source string, target string, kind string, confidence double"
NODE = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, docstring string, is_exported boolean, rank double"


def edges(spark, *pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, 1.0) for a, b in pairs], EDGE)


def nodes(spark, *ids, **more):
    return spark.createDataFrame([(i, more.get("kind", "function"), i, f"m::{i}", more.get("path", "src/a.rs"), 1, 3, None, None, False, 0.0) for i in ids], NODE)


def values(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_impact_depths_and_limits(spark):
    e = edges(spark, ("b", "a"), ("c", "b"))
    seeds = spark.createDataFrame([("a",)], "id string")
    assert values(graph.impact(e, seeds, 5), "id", "depth") == {("b", 1), ("c", 2)}
    assert values(graph.impact(e, seeds, 1), "id") == {("b",)}
    loop = edges(spark, ("a", "b"), ("b", "a"), ("b", "b"))
    assert values(graph.impact(loop, seeds, 5), "id", "depth") == {("b", 1)}
    many = edges(spark, *((f"x{k}", "a") for k in range(9)))
    ranked = nodes(spark, "a", *(f"x{k}" for k in range(9)))
    assert graph.impact(many, seeds, 2, ranked, per_node=4).count() == 4
    assert graph.impact(e, seeds.limit(0), 3).count() == 0


def test_impact_grows_with_depth(spark):
    rng = random.Random(4)
    e = edges(spark, *{(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)})
    seeds = spark.createDataFrame([("n0",), ("n1",)], "id string")
    before = set()
    for depth in (1, 2, 4, 6):
        now = values(graph.impact(e, seeds, depth), "seed", "id")
        assert before <= now
        before = now


def test_two_seeds_a_node_tell_all_that_reach_another(spark):
    rng = random.Random(9)
    for _ in range(3):
        e = edges(spark, *{(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)})
        seeds = spark.createDataFrame([(f"n{k}",) for k in rng.sample(range(25), 9)], "id string")
        for depth in (1, 3):
            assert values(graph.impact(e, seeds, depth), "id") == values(graph.impact(e, seeds, depth, most_seeds=2), "id")


def test_paths(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "z"), ("z", "c"))
    assert graph.call_path(e, "a", "c") == ["a", "b", "c"]
    assert graph.call_path(e, "c", "a") is None
    assert graph.call_path(e, "a", "a") == ["a"]


def test_paths_of_any_length(spark):
    e = edges(spark, *((f"n{k:03}", f"n{k + 1:03}") for k in range(200)), ("n000", "x"), ("x", "n002"))
    assert graph.call_path(e, "n000", "n200") == [f"n{k:03}" for k in range(201)]
    assert graph.call_path(e, "n000", "n200", max_visited=100) is None
    assert graph.call_path(e.filter("source < 'n018'"), "n000", "n018", one_task=0) == [f"n{k:03}" for k in range(19)]
    assert graph.call_path(e, "n000", "n200", max_visited=3, one_task=0) is None


def test_pagerank_values_both_ways(spark):
    e = edges(spark, ("b", "a"), ("c", "b"))
    want = {"a": 1.0, "b": 0.719145, "c": 0.388727}
    for one_task in (10**6, 0):
        got = {r["id"]: round(r["rank"], 6) for r in graph.pagerank(nodes(spark, "a", "b", "c"), e, one_task=one_task).collect()}
        assert got == want
    e = edges(spark, ("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("d", "b"), ("x", "a"))
    got = {r["id"]: round(r["rank"], 6) for r in graph.pagerank(nodes(spark, "a", "b", "c", "d"), e, one_task=0).collect()}
    assert got == {"a": 1.0, "b": 0.965541, "c": 0.115541, "d": 0.081081}
    assert graph.pagerank(nodes(spark, "a").limit(0), e).count() == 0


def test_cycles_by_one_task_and_by_rounds(spark):
    rng = random.Random(8)
    for trial in range(2):
        pairs = {(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(38)} | {("p", "q"), ("q", "p"), ("s", "s")}
        e = edges(spark, *pairs)
        assert values(graph.cycles(e), "component", "id", "size") == values(graph.cycles(e, one_task=0), "component", "id", "size")
    assert values(graph.cycles(edges(spark, ("ping", "pong"), ("pong", "ping"))), "component", "id") == {("ping", "ping"), ("ping", "pong")}
    assert graph.cycles(edges(spark, ("a", "a"), ("a", "b"))).count() == 0


def test_neighbours_and_containers(spark):
    e = edges(spark, ("run", "helper"), ("test_run", "run")).unionByName(edges(spark, ("T", "run"), kind="contains"))
    n = nodes(spark, "run", "helper", "test_run").unionByName(nodes(spark, "T", kind="struct"))
    assert values(graph.callers(e, n), "target", "source") == {("helper", "run"), ("run", "test_run")}
    assert values(graph.callees(e, n), "source", "target") == {("run", "helper"), ("test_run", "run")}
    assert values(graph.container_of(e, n), "target", "container") == {("run", "T")}
    assert values(analysis.related_tests(e, n, spark.createDataFrame([("helper",)], "id string")), "id") == {("test_run",)}
    assert values(graph.degrees(e, n), "id", "fan_in", "fan_out") == {("run", 1, 1), ("helper", 1, 0), ("test_run", 0, 1), ("T", 0, 0)}


def test_co_change(spark):
    commits = lambda *sets: spark.createDataFrame([(str(k), f) for k, files in enumerate(sets) for f in files], "commit string, file string")
    assert [tuple(r) for r in analysis.co_change(commits("ab", "ab", "a"), 2).collect()] == [("a", "b", 2, 1.0)]
    assert analysis.co_change(commits("ab"), 2).count() == 0 and analysis.co_change(commits("ab"), 1).count() == 1
    assert analysis.co_change(commits([f"f{k}" for k in range(50)]), 1).count() == 0


def test_changed_symbols(spark):
    n = nodes(spark, "a")
    lines = lambda *x: spark.createDataFrame([("src/a.rs", k) for k in x], "file_path string, line int")
    assert analysis.changed_symbols(n, lines(3, 9)).count() == 1 and analysis.changed_symbols(n, lines(4)).count() == 0


def test_fuzzy_scores(spark):
    sim = lambda a, b: one(spark, t.jaccard(t.trigrams(F.lit(a)), t.trigrams(F.lit(b))))
    assert sim("getUser", "getUser") == 1.0
    assert sim("getUser", "getUsr") == pytest.approx(6 / 11)
    assert sim("getUser", "shutdownReactor") == pytest.approx(0.04)
    score = lambda q, n, qn: one(spark, t.fuzzy_score(F.lit(q), F.lit(n), F.lit(qn)))
    assert score("user", "createUser", "svc::createUser") == pytest.approx(0.585714, abs=1e-6)
    assert score("user", "shutdown", "svc::shutdown") == 0.0


def test_tokens_and_buckets(spark):
    tokens = lambda s: one(spark, t.identifier_tokens(F.lit(s)))
    assert sorted(tokens("validateToken")) == ["token", "validate"]
    assert sorted(tokens("get_user_id2")) == ["get", "id", "user"]
    assert sorted(tokens("sha256sum")) == ["256", "sha", "sum"]
    assert tokens("HTTPServer é") == ["httpserver", "é"]
    want = {"validate": 43, "token": 82, "get": 247, "user": 242, "id": 192, "sha": 237, "256": 34, "sum": 168, "": 0x25}
    for token, bucket in want.items():
        assert one(spark, t.fnv_bucket(F.lit(token))) == bucket
    full = 0xCBF29CE484222325
    for b in "ñandú".encode():
        full = ((full ^ b) * 0x100000001B3) & ((1 << 64) - 1)
    assert one(spark, t.fnv_bucket(F.lit("ñandú"))) == full % 256


def test_fusion(spark):
    lists = [spark.createDataFrame(x, "id string, position int") for x in ([("a", 1), ("b", 2)], [("b", 1), ("c", 2)])]
    got = [tuple(r) for r in search.fuse(lists).collect()]
    assert got == [("b", pytest.approx(1 / 61 + 1 / 62)), ("a", pytest.approx(1 / 61)), ("c", pytest.approx(1 / 62))]
    assert [tuple(r) for r in search.fuse(lists[::-1]).collect()] == got


def corpus(spark):
    rows = [("a", "function", "parseConfig", "x::parseConfig", "src/a.rs", 1, 2, "fn parseConfig(path)", "Reads the config file", True, 0.0), ("b", "struct", "Config", "x::Config", "src/a.rs", 4, 5, "struct Config", None, True, 0.9), ("c", "function", "renderHtml", "y::renderHtml", "src/b.rs", 1, 1, None, None, False, 0.0)]
    return spark.createDataFrame(rows, NODE)


def test_full_text_and_smart_search(spark):
    n = corpus(spark)
    assert [r["id"] for r in search.full_text(n, "config").collect()] == ["b", "a"]  # the rank counts
    assert [r["id"] for r in search.full_text(n, "config file").collect()] == ["a"]
    assert [r["id"] for r in search.full_text(n, "rend*").collect()] == ["c"]
    assert [r["id"] for r in search.full_text(n, "config", kind="struct").collect()] == ["b"]
    for bad in ('"open', "* x", "", "  "):
        with pytest.raises(ValueError):
            search.smart_search(n, bad)
    got = search.smart_search(n, "renderHtm", limit=2).collect()
    assert got[0]["id"] == "c"
    assert search.smart_search(n, "renderHtm", kind="struct", limit=2).count() <= 1
    idf = lambda df: math.log((3 - df + 0.5) / (df + 0.5) + 1)
    lengths = {"a": 9, "b": 5, "c": 3}
    score = {r["id"]: r["score"] for r in search.full_text(n, "config").collect()}
    mean = sum(lengths.values()) / 3
    for i, rank in (("a", 0.0), ("b", 0.9)):
        tf = 1 if i == "a" else 3
        assert score[i] == pytest.approx(-idf(2) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) - 5 * rank) or i


def test_vectors_relate_names(spark):
    n = corpus(spark)
    score = {r["id"]: r["score"] for r in search.vector_search(n, "parse config", 5).collect()}
    assert score["a"] > score.get("c", 0.0)


def test_packing_by_budget(spark):
    items = spark.createDataFrame([("a", 1, 90), ("b", 2, 40), ("c", 3, 10), ("d", 4, 1)], "id string, position int, tokens int")
    got = lambda budget: [r["id"] for r in context.pack_greedily(items, budget).orderBy("position").collect()]
    assert got(1) == ["a"] and got(100) == ["a", "c"] and got(101) == ["a", "c", "d"] and got(1000) == list("abcd")


REF = "ref_id bigint, source_node_id string, target_name string, kind string, file_path string, receiver_hint string"


def test_resolution_tiers(spark):
    def node(i, kind, name, file):
        return (i, kind, name, f"{file}::{name}", file, 1, 1, None, None, False, 0.0)

    n = spark.createDataFrame([node("T", "struct", "T", "a.rs"), node("B", "class", "Base", "b.rs"), node("f1", "method", "f", "a.rs"), node("f2", "method", "f", "b.rs"), node("f3", "function", "f", "c.rs"), node("g", "function", "g", "a.rs"), node("m", "method", "m", "a.rs"), node("v", "field", "f", "a.rs"), node("k1", "function", "k", "d.py"), node("k2", "function", "k", "e.py"), node("k3", "function", "k", "h.py")], NODE)
    e = edges(spark, ("T", "f1"), ("B", "f2"), ("T", "m"), kind="contains")
    rows = [
        (1, "g", "f", "calls", "z.rs", "!Base"), (2, "g", "f", "calls", "z.rs", "!Vec"), (3, "m", "f", "calls", "z.rs", "Self"), (4, "m", "f", "calls", "z.rs", None), (5, "g", "f", "calls", "c.rs", None),
        (6, "g", "g", "calls", "z.rs", None), (7, "f3", "f", "calls", "z.rs", None), (8, "f3", "k", "calls", "q.py", None), (9, "f3", "d.k", "imports", "q.py", None), (10, "f3", "k", "calls", "r.py", None), (11, "f3", "x.d", "imports", "r.py", None), (12, "f3", "e", "imports", "r.py", None), (13, "g", "nothing", "calls", "z.rs", None), (14, "f1", "f", "references", "z.rs", None),
    ]
    one_by_one = lambda k: {(r["target"], r["confidence"]) for r in resolve.resolve(spark.createDataFrame([x for x in rows if x[0] == k], REF), n, e, spark.createDataFrame(rows, REF)).collect()}
    assert one_by_one(1) == {("f2", 0.98)}
    assert one_by_one(2) == set() and one_by_one(13) == set()
    assert one_by_one(3) == {("f1", 0.98)}
    assert one_by_one(4) == {("f1", 0.97)}
    assert one_by_one(5) == {("f3", 0.90)}
    assert one_by_one(6) == {("g", 1.00)}
    assert one_by_one(7) == {("f1", 0.40), ("f2", 0.40), ("f3", 0.40)}
    assert one_by_one(8) == {("k1", 0.80)}
    assert one_by_one(10) == {("k1", 0.60), ("k2", 0.60)}
    assert one_by_one(14) == {("f1", 0.40), ("f2", 0.40), ("f3", 0.40), ("v", 0.40)}
    every = resolve.resolve(spark.createDataFrame(rows, REF), n, e)
    assert every.count() == every.select("source", "target", "kind").distinct().count()


def test_common_names_are_resolved_as_rare_ones(spark):
    from weftgraph.plans.graph_queries import _code
    from weftgraph.plans.projections import frame

    sf = "/root/testdata/sf0.001"
    refs, code, contains = frame(spark, sf, "refs").unionByName(frame(spark, sf, "base_refs")), _code(spark, sf), frame(spark, sf, "contains_edges")
    columns = ("source", "target", "kind", "confidence", "tier")
    want = values(resolve.resolve(refs, code, contains), *columns)
    assert len({w[4] for w in want}) >= 5
    for few in (0, 2):
        assert values(resolve.resolve(refs, code, contains, few=few), *columns) == want


def test_inherited_calls(spark):
    rows = [("T", "struct", "T", "T", "a.rs"), ("B", "class", "Base", "Base", "b.rs"), ("f2", "method", "f", "b::f", "b.rs"), ("f3", "function", "f", "c::f", "c.rs"), ("m", "method", "m", "a::m", "a.rs")]
    n = spark.createDataFrame([(*r, 1, 1, None, None, False, 0.0) for r in rows], NODE)
    e = edges(spark, ("B", "f2"), ("T", "m"), kind="contains")
    refs = spark.createDataFrame([(1, "m", "f", "calls", "z.rs", None), (2, "T", "Base", "extends", "a.rs", None)], REF)
    assert values(resolve.resolve(refs, n, e), "source", "target", "confidence") == {("m", "f2", 0.85), ("T", "B", 1.0)}


def test_tables(spark):
    old = spark.createDataFrame([("a", "rust", "h1"), ("b", "go", "h2")], "path string, language string, content_hash string")
    new = spark.createDataFrame([("b", "c", "h3", 1), ("b", "cpp", "h4", 2), ("d", "c", "h5", 1)], "path string, language string, content_hash string, seq int")
    assert values(tables.upsert(old, new, ["path"], "seq", ("language",)), "path", "language", "content_hash") == {("a", "rust", "h1"), ("b", "go", "h4"), ("d", "c", "h5")}
    twice = spark.createDataFrame([("a", "b", "calls", 0.4, 1), ("a", "b", "calls", 0.9, 2)], EDGE + ", seq int")
    assert values(tables.scored_edges(twice, "seq"), "confidence") == {(0.9,)}
    n, e = nodes(spark, "a", path="x.rs").unionByName(nodes(spark, "b", path="y.rs")), edges(spark, ("a", "b"))
    left, between, _ = tables.delete_files(n, e, None, spark.createDataFrame([("x.rs",)], "file_path string"))
    assert left.count() == 1 and between.count() == 0
    fresh = old.filter("path = 'a'")
    assert values(tables.pruned(old, fresh), "path") == {("b",)} and values(tables.stale(old, fresh), "path") == {("b",)}


@pytest.mark.parametrize("name,path,kind,want", [("test_run", "src/a.rs", "function", True), ("run", "src/tests/a.rs", "function", True), ("shouldWork", "a.test.ts", "function", True), ("run", "src/a.rs", "function", False), ("run", "src/tests/a.rs", "struct", False), ("latest", "src/latest.py", "function", False)])
def test_which_are_tests(spark, name, path, kind, want):
    assert one(spark, paths.is_test(F.lit(kind), F.lit(name), F.lit(path), F.lit("m::x"))) is want


def test_path_functions(spark):
    lang = lambda p: one(spark, paths.language(F.lit(p)))
    assert [lang(p) for p in ("a.rs", "b.tsx", "c.h", "d.pyi", "e.vue", "README.md", "x")] == ["rust", "typescript", "c", "python", "vue", None, None]
    refined = lambda p, s: one(spark, paths.refined_language(paths.language(F.lit(p)), F.lit(p), F.lit(s)))
    assert [refined("a.h", "class X"), refined("a.h", "int x;"), refined("a.c", "class X")] == ["cpp", "c", "c"]
    assert one(spark, paths.ignored(F.lit("/p/target/debug/main.rs"))) and not one(spark, paths.ignored(F.lit("/p/src/main.rs")))
    layer = lambda p: spark.createDataFrame([(p,)], "path string").select(paths.layer(F.col("path"), "/r").alias("x")).first()["x"]
    assert [layer("/r/src/a.rs"), layer("/r/a.rs"), layer("/r/x/y/z")] == ["src", "(root)", "x"]
    assert [one(spark, paths.stem(F.lit(p))) for p in ("a/b.test.ts", "x", ".hidden")] == ["b.test", "x", ".hidden"]


def shuffled_rows(df):
    """Rows that the plan of ``df``, once collected, wrote to shuffles."""
    def rows(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return rows(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return rows(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(rows(plan.children().apply(k)) for k in range(plan.children().size()))

    return rows(df._jdf.queryExecution().executedPlan())


CODE = "id string, kind string, name string, qualified_name string, file_path string"


def changed_edges(spark, nodes, rows):
    """Edges after the symbols of d/0.rs got their names back."""
    old = [(i, kind, "g" if file == "d/0.rs" else name, q, file) for i, kind, name, q, file in nodes]
    old, new = (spark.createDataFrame(x, CODE) for x in (old, nodes))
    return resolve.resolve_changed(spark.createDataFrame(rows, REF), old, new, edges(spark, ("x", "y"), kind="contains"), spark.createDataFrame([("d/0.rs",)], "file_path string"))


def test_changed_files_do_not_shuffle_all_edges_of_common_names(spark):
    """30 callers of a name of 200 nodes."""
    n = [(f"t{k}", "function", "f", f"m{k}::f", f"d/{k % 2}.rs") for k in range(200)] + [(f"s{k}", "function", f"s{k}", f"m::s{k}", "d/1.rs") for k in range(30)]
    found = changed_edges(spark, n, [(k, f"s{k}", "f", "calls", "d/1.rs" if k else "z.rs", None) for k in range(30)] + [(31, "s1", "s2", "calls", "d/1.rs", None)])
    want = {(f"s{s}", f"t{t}", 0.9, "same_file") for s in range(1, 30) for t in range(1, 200, 2)} | {("s0", f"t{t}", 0.4, "any") for t in range(200)} | {("s1", "s2", 1.0, "only")}
    rows = [(r["source"], r["target"], float(r["confidence"]), r["tier"]) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) > 3000
    assert shuffled_rows(found) < 1500


def test_an_edge_by_two_names_is_found_anew_once(spark):
    n = [("t0", "function", "f", "m0::f", "d/0.rs"), ("t1", "function", "f", "m1::f", "d/1.rs"), ("s0", "function", "s0", "m::s0", "z.rs")]
    found = changed_edges(spark, n, [(1, "s0", "f", "calls", "z.rs", None), (2, "s0", "m1::f", "calls", "z.rs", None)])
    assert sorted((r["target"], r["tier"]) for r in found.collect()) == [("t0", "any"), ("t1", "any")]


def test_candidates_are_all_pairs_however_lists_and_shares_are_cut(spark):
    kinds = [None, "function", "method", "class", "trait", "enum", "protocol", "struct"]
    nodes = [(f"n{i % 37}", kinds[i % 8], [None, "a", "b", "a::b"][i % 4], [None, "a", "m::a", "b", "a::b"][i % 5]) for i in range(80)]
    refs = [(i % 50, ["a", "b", "a::b", "m::a", "gone", None][i % 6], ["calls", "extends", "implements", "instantiates", "imports", None, "references"][i % 7]) for i in range(100)]
    allowed = lambda kind, node: kind not in resolve.TARGET_KINDS or node in resolve.TARGET_KINDS[kind]
    want = Counter((r, k, i, n) for r, t, k in refs for i, n, *names in nodes if t is not None and t in names and allowed(k, n))
    frames = spark.createDataFrame(refs, "ref_id long, target_name string, kind string"), spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string")
    assert len(want) > 300
    for how in ({}, {"listed": 3, "work": 20}):
        found = resolve.candidates(*frames, **how).select("ref_id", "kind", "candidate", "node_kind").collect()
        assert Counter(map(tuple, found)) == want
    few = resolve.candidates(*frames, "name").filter("name IS NULL").count()
    assert few == sum(r[1] is not None and allowed(r[2], n[1]) for r in refs for n in nodes if n[2] is None and r[1] == n[3])
    assert resolve.candidates(frames[0].filter("ref_id < 0"), frames[1]).isEmpty() and resolve.candidates(frames[0], frames[1].filter("id = ''")).isEmpty()


def test_written_candidates_of_common_names_take_little_space(spark, tmp_path):
    refs = spark.range(6400).select(F.col("id").alias("ref_id"), F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(64))).alias("target_name"), F.lit("calls").alias("kind"))
    nodes = spark.range(64 * 300).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("method").alias("kind"), F.concat(F.lit("f"), F.col("id") % 64).alias("name"), F.concat(F.lit("m::p"), "id").alias("qualified_name"), F.lit("src/a.rs").alias("file_path"))
    resolve.candidates(refs, nodes).select("ref_id", "candidate", "node_kind").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 6400 * 300
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.4 * 6400 * 300
