"""Relational queries: scans, filters, joins, aggregates, set operations and changes of tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import resolve, tables
from .projections import frame, oracle
from .registry import query


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("""SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM lineitem) AS edges""")
def a1_stats(spark, sf):
    return tables.stats(_read(spark, sf, "documents"), _read(spark, sf, "part"), _read(spark, sf, "lineitem"))


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def a2_by_language(spark, sf):
    return tables.count_by(_read(spark, sf, "documents").withColumnRenamed("lang", "language"), "language")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def a3_by_kind(spark, sf):
    return tables.count_by(_read(spark, sf, "events").withColumnRenamed("event_type", "kind"), "kind")


@query(f"WITH {oracle('refs')} SELECT kind, count(*) AS n, count(receiver_hint) AS hinted, count(DISTINCT target_name) AS names FROM refs GROUP BY kind")
def a4_refs_by_kind(spark, sf):
    return frame(spark, sf, "refs").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("receiver_hint").alias("hinted"), F.countDistinct("target_name").alias("names"))


@query(f"WITH {oracle('part_nodes')} SELECT DISTINCT x AS name FROM (SELECT name AS x FROM part_nodes WHERE file_path LIKE '%brand_3.rs' UNION SELECT qualified_name FROM part_nodes WHERE file_path LIKE '%brand_3.rs')")
def a8_distinct_names(spark, sf):
    here = frame(spark, sf, "part_nodes").filter(F.endswith("file_path", F.lit("brand_3.rs")))
    return here.select("name").union(here.select("qualified_name")).distinct()


@query(f"""WITH {oracle('supply_edges')} SELECT target AS file, count(*) AS n, string_agg(source, ',' ORDER BY source) AS callers FROM supply_edges WHERE confidence >= 0.3 GROUP BY target""")
def a11_grouped(spark, sf):
    return frame(spark, sf, "supply_edges").filter("confidence >= 0.3").groupBy(F.col("target").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("callers"))


@query(f"WITH {oracle('supply_nodes')} SELECT id, round(rank / max(rank) OVER (), 6) AS rank FROM supply_nodes")
def a12_normalised_ranks(spark, sf):
    from ..operators.graph import normalised

    return normalised(frame(spark, sf, "supply_nodes").select("id", "rank")).withColumn("rank", F.round("rank", 6))


@query(f"WITH {oracle('part_nodes')}, x AS (SELECT DISTINCT p_name || ' 3' AS x FROM part) SELECT DISTINCT n.id, n.name, n.qualified_name FROM part_nodes n, x WHERE n.name = x.x OR n.qualified_name = x.x")
def f1_exact_lookup(spark, sf):
    wanted = _read(spark, sf, "part").select(F.concat("p_name", F.lit(" 3")).alias("target_name")).distinct()
    return tables.lookup(frame(spark, sf, "part_nodes"), wanted).select("id", "name", "qualified_name")


@query("""SELECT k.kind AS edge_kind, n.kind AS node_kind FROM (VALUES ('calls'), ('extends'), ('implements'), ('instantiates'), ('references')) k(kind), (VALUES ('function'), ('method'), ('class'), ('struct'), ('trait'), ('enum'), ('interface'), ('protocol'), ('type_alias'), ('field')) n(kind)
WHERE CASE k.kind WHEN 'calls' THEN n.kind IN ('function','method') WHEN 'extends' THEN n.kind IN ('class','struct','interface','trait','enum','type_alias') WHEN 'implements' THEN n.kind IN ('trait','interface','protocol') WHEN 'instantiates' THEN n.kind IN ('class','struct','interface','enum') ELSE true END""")
def f3_kind_compatibility(spark, sf):
    kinds = spark.createDataFrame([(k,) for k in ("calls", "extends", "implements", "instantiates", "references")], "edge_kind string")
    nodes = spark.createDataFrame([(k,) for k in ("function", "method", "class", "struct", "trait", "enum", "interface", "protocol", "type_alias", "field")], "node_kind string")
    return kinds.crossJoin(nodes).filter(resolve.compatible(F.col("edge_kind"), F.col("node_kind")))


@query("""WITH fresh AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 13 <> 5), known AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE md5(text) END AS h FROM documents WHERE doc_id % 17 <> 3)
SELECT fresh.doc_id FROM fresh LEFT JOIN known USING (doc_id) WHERE known.h IS NULL OR known.h <> fresh.h""")
def f4_changed_files(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    fresh = docs.filter("doc_id % 13 <> 5")
    known = docs.filter("doc_id % 17 <> 3").withColumn("content_hash", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("content_hash")))
    return tables.changed(fresh, known, "doc_id").select("doc_id")


@query("""WITH fresh AS (SELECT doc_id FROM documents WHERE doc_id % 13 <> 5) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fresh)""")
def j9_pruned(spark, sf):
    known = _read(spark, sf, "documents").select("doc_id")
    return tables.pruned(known, known.filter("doc_id % 13 <> 5"), "doc_id")


@query("""WITH fresh AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 13 <> 5), known AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE md5(text) END AS h FROM documents)
SELECT known.doc_id FROM known LEFT JOIN fresh USING (doc_id) WHERE fresh.h IS NULL OR known.h <> fresh.h""")
def s13_stale_files(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    known = docs.withColumn("content_hash", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("content_hash")))
    return tables.stale(known, docs.filter("doc_id % 13 <> 5"), "doc_id").select("doc_id")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') || CASE page_id % 6 WHEN 0 THEN '/tests/a.rs' WHEN 1 THEN '/x_test.go' WHEN 2 THEN '/test_y.py' WHEN 3 THEN '/z.spec.ts' WHEN 4 THEN '/latest.py' ELSE '/FooTest.java' END AS path,
 CASE page_id % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'Test' WHEN 2 THEN 'check_spec' ELSE 'testing' END AS name, CASE page_id % 3 WHEN 0 THEN 'struct' ELSE 'function' END AS kind FROM pages),
q AS (SELECT *, lower(path) AS l, regexp_extract(lower(path), '[^/]*$') AS f, lower(name) AS n, CASE page_id % 5 WHEN 0 THEN 'a::tests::b' ELSE 'a::b' END AS qn FROM p)
SELECT page_id, kind IN ('function', 'method') AND (regexp_matches(l, '/(test|tests|spec|__tests__)/') OR starts_with(f, 'test_') OR regexp_matches(f, '(_test\.(go|py|rb|rs|dart)|_spec\.rb|\.test\.(ts|tsx|js|jsx)|\.spec\.(ts|tsx|js)|test\.java|tests\.cs|test\.kt)$')
 OR n = 'test' OR starts_with(n, 'test_') OR n LIKE '%\_test' ESCAPE '\' OR n LIKE '%\_spec' ESCAPE '\' OR contains(qn, '::tests::')) AS is_test FROM q""")
def f6_test_predicate(spark, sf):
    tails = F.element_at(F.array(*map(F.lit, ("/tests/a.rs", "/x_test.go", "/test_y.py", "/z.spec.ts", "/latest.py", "/FooTest.java"))), (F.col("page_id") % 6 + 1).cast("int"))
    names = F.element_at(F.array(*map(F.lit, ("run", "Test", "check_spec", "testing"))), (F.col("page_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("page_id") % 3 == 0, "struct").otherwise("function")
    qualified = F.when(F.col("page_id") % 5 == 0, "a::tests::b").otherwise("a::b")
    path = F.concat(F.regexp_replace("url", "^https?://[^/]*/", ""), tails)
    return _read(spark, sf, "pages").select("page_id", paths.is_test(kind, names, path, qualified).alias("is_test"))


@query(f"""WITH {oracle('refs', 'part_nodes')}, seg AS (SELECT DISTINCT file_path, unnest(regexp_split_to_array(lower(target_name), '[^a-z0-9_]+')) AS stem FROM refs WHERE kind = 'imports'),
f AS (SELECT DISTINCT file_path AS candidate_file, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM part_nodes)
SELECT seg.file_path, f.candidate_file FROM seg JOIN f ON f.stem = seg.stem WHERE seg.stem <> ''""")
def f7_import_evidence(spark, sf):
    segments = resolve.import_segments(frame(spark, sf, "refs")).withColumnRenamed("segment", "stem")
    files = frame(spark, sf, "part_nodes").select(F.col("file_path").alias("candidate_file")).distinct().withColumn("stem", F.lower(paths.stem(F.col("candidate_file"))))
    return segments.join(files, "stem").select("file_path", "candidate_file")


@query(r"""SELECT p_partkey, split_part(split_part(x, '<', 1), '::', -1) AS token FROM (SELECT p_partkey, regexp_extract('impl ' || p_type || ' for a::' || replace(p_brand, '#', '') || '<T>', '\S+$') AS x FROM part)""")
def f8_type_token(spark, sf):
    spelled = F.concat(F.lit("impl "), "p_type", F.lit(" for a::"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("<T>"))
    return _read(spark, sf, "part").select("p_partkey", resolve.type_token(spelled).alias("token"))


@query(r"""SELECT page_id, url FROM pages WHERE length(url) - length(replace(url, '/', '')) <= 4""")
def f10_files_depth(spark, sf):
    return _read(spark, sf, "pages").filter(paths.depth(F.col("url")) <= 4).select("page_id", "url")


@query("""SELECT event_id, CAST(value AS INT) % 7 AS parse_errors, CAST(value AS INT) % 3 AS parse_missing FROM events WHERE CAST(floor(value) AS INT) % 7 + CAST(floor(value) AS INT) % 3 > 0 ORDER BY CAST(floor(value) AS INT) % 7 + CAST(floor(value) AS INT) % 3 DESC, event_id LIMIT 100""".replace("CAST(value AS INT)", "CAST(floor(value) AS INT)"))
def f11_parse_issues(spark, sf):
    whole = F.floor("value").cast("int")
    files = _read(spark, sf, "events").select("event_id", (whole % 7).alias("parse_errors"), (whole % 3).alias("parse_missing"))
    return tables.parse_issues(files, "event_id").limit(100)


@query(f"""WITH {oracle('refs', 'part_nodes')} SELECT ref_id FROM refs WHERE target_name IN (SELECT name FROM part_nodes WHERE file_path LIKE 'src/promo/%')""")
def f12_refs_to_names(spark, sf):
    names = frame(spark, sf, "part_nodes").filter(F.startswith("file_path", F.lit("src/promo/"))).select(F.col("name").alias("target_name")).distinct()
    return frame(spark, sf, "refs").join(names, "target_name", "left_semi").select("ref_id")


@query(f"""WITH {oracle('part_nodes')} SELECT id, kind, name, start_line FROM part_nodes WHERE file_path = 'src/economy/brand_7.rs'""")
def s15_nodes_in_file(spark, sf):
    return tables.nodes_in_file(frame(spark, sf, "part_nodes"), "src/economy/brand_7.rs").select("id", "kind", "name", "start_line")


@query(f"""WITH {oracle('part_nodes')} SELECT id, name, rank FROM part_nodes WHERE kind <> 'file' ORDER BY rank DESC, id LIMIT 40""")
def t2_top_nodes(spark, sf):
    return tables.top_nodes(frame(spark, sf, "part_nodes"), 40).select("id", "name", "rank")


@query("""SELECT path, language, content_hash, size FROM (SELECT source AS path, lang AS language, md5(text) AS content_hash, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1""")
def k1_upsert_files(spark, sf):
    docs = _read(spark, sf, "documents").select(F.col("source").alias("path"), F.col("lang").alias("language"), F.md5("text").alias("content_hash"), F.col("n_chars").alias("size"), F.col("doc_id").alias("seq"))
    half = docs.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    old = tables.last_of(docs.filter(F.col("seq") <= half), ["path"], "seq").drop("seq")
    return tables.upsert(old, docs.filter(F.col("seq") > half), ["path"], "seq").select("path", "language", "content_hash", "size")


@query(f"""WITH {oracle('commits')} SELECT a AS source, b AS target, 'calls' AS kind, arg_max(c, seq) AS confidence FROM (SELECT l_suppkey % 40 AS a, l_partkey % 40 AS b, round(l_discount, 2) AS c, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber + l_quantity / 1000 + l_tax / 100000 AS seq FROM lineitem) GROUP BY 1, 2""")
def k4_scored_edges(spark, sf):
    li = _read(spark, sf, "lineitem")
    rows = li.select((F.col("l_suppkey") % 40).alias("source"), (F.col("l_partkey") % 40).alias("target"), F.lit("calls").alias("kind"), F.round("l_discount", 2).alias("confidence"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_linenumber") + F.col("l_quantity") / 1000 + F.col("l_tax") / 100000).alias("seq"))
    return tables.scored_edges(rows, "seq").select("source", "target", "kind", "confidence")


@query(f"""WITH {oracle('supply_edges', 'supply_nodes')}, gone AS (SELECT id FROM supply_nodes WHERE file_path LIKE 'suppliers/n1%')
SELECT source, target FROM supply_edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)""")
def k5_delete_cascade(spark, sf):
    nodes = frame(spark, sf, "supply_nodes")
    files = nodes.filter(F.startswith("file_path", F.lit("suppliers/n1"))).select("file_path").distinct()
    return tables.delete_files(nodes, frame(spark, sf, "supply_edges"), None, files)[1].select("source", "target")


@query("""WITH a AS (SELECT p_partkey AS k, 0 AS first FROM part WHERE p_size < 20), b AS (SELECT p_partkey AS k, 1 AS first FROM part WHERE p_size > 10) SELECT k, min(first) AS first FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k""")
def u2_ref_union(spark, sf):
    part = _read(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return tables.union_first([part.filter("p_size < 20").select("k"), part.filter("p_size > 10").select("k")], ["k"]).select("k", "first")


@query(f"""WITH {oracle('commits')} SELECT file, count(*) AS changes, count(DISTINCT commit) AS commits FROM commits GROUP BY file""")
def a7_file_changes(spark, sf):
    return frame(spark, sf, "commits").groupBy("file").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("commit").alias("commits"))


@query("SELECT c_custkey, c_name, rn FROM (SELECT c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3".replace("rn FROM (", "CAST(rn AS INT) AS rn FROM ("))
def w1_topk_per_key(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return _read(spark, sf, "customer").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("c_custkey", "c_name", "rn")
