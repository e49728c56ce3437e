"""Search queries over the projected tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import context, search
from .projections import frame, oracle
from .registry import query

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tokens_sql(c: str) -> str:
    spaced = f"regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for a, b in (("Ll", "Lu"), ("L", "N"), ("N", "L")):
        spaced = f"regexp_replace({spaced}, '(\\p{{{a}}})(\\p{{{b}}})', '\\1 \\2', 'g')"
    return f"list_filter(string_split({_LOWER.format(spaced)}, ' '), lambda x: strlen(x) >= 2)"


def _bucket_sql(c: str) -> str:
    return f"list_reduce(list_transform(range(0, strlen({c})), lambda i: CAST('0x' || substr(hex(encode({c})), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)), lambda h, b: (xor(h, b) * 179) % 256, 37)"


def _trigrams_sql(c: str) -> str:
    padded = f"('  ' || trim(regexp_replace({_LOWER.format(c)}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g')) || '  ')"
    return f"list_distinct(list_transform(range(1, length({padded}) - 1), lambda i: substr({padded}, i, 3)))"


def _similar_sql(a: str, b: str) -> str:
    return f"(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


@query(f"""WITH {oracle("corpus")},
d AS (SELECT id, rank, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, qualified_name, coalesce(signature, ''), coalesce(docstring, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM corpus),
s AS (SELECT id, rank, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'of')) AS b FROM d),
c AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM s)
SELECT id, round(-(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m))) - 5 * rank, 6) AS score
FROM s, c WHERE a > 0 AND b > 0 ORDER BY score, id LIMIT 20""")
def q1_bm25(spark, sf):
    return search.full_text(frame(spark, sf, "corpus"), "the of", limit=20).withColumn("score", F.round("score", 6))


@query(f"""WITH {oracle("part_nodes")}
SELECT term, count(DISTINCT id) AS nodes, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', name, qualified_name, signature, docstring)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term, 1 AS tf FROM part_nodes) GROUP BY term""")
def q1_postings(spark, sf):
    return search.postings(frame(spark, sf, "part_nodes")).groupBy("term").agg(F.count(F.lit(1)).alias("nodes"), F.sum("tf").alias("tf"))


@query(f"""WITH {oracle("part_nodes")}, x AS (SELECT id, {_trigrams_sql("name")} AS a, {_trigrams_sql("'small wdget 3'")} AS q FROM part_nodes)
SELECT id, len(a) AS n, round({_similar_sql("a", "q")}, 6) AS similarity FROM x""")
def q2_trigram(spark, sf):
    grams = t.trigrams(F.col("name"))
    return frame(spark, sf, "part_nodes").select("id", F.size(grams).cast("bigint").alias("n"), F.round(t.jaccard(grams, t.trigrams(F.lit("small wdget 3"))), 6).alias("similarity"))


@query(f"""WITH {oracle("part_nodes")}, pool AS (SELECT * FROM part_nodes WHERE kind <> 'file' ORDER BY rank DESC, id LIMIT 5000),
x AS (SELECT id, name, {_trigrams_sql("name")} AS a, {_trigrams_sql("qualified_name")} AS b, {_trigrams_sql("'blue widgt'")} AS q FROM pool),
s AS (SELECT id, least(1.0, greatest({_similar_sql("a", "q")}, {_similar_sql("b", "q")}) + CASE WHEN contains({_LOWER.format("name")}, 'blue widgt') THEN 0.3 ELSE 0.0 END) AS score FROM x)
SELECT id, round(score, 6) AS score FROM s WHERE score > 0.15 ORDER BY s.score DESC, id LIMIT 20""")
def q4_fuzzy_search(spark, sf):
    return search.fuzzy(frame(spark, sf, "part_nodes"), "blue widgt", 20).withColumn("score", F.round("score", 6))


@query(f"""WITH {oracle("part_nodes")} SELECT id, array_to_string({_tokens_sql("docstring || 'HTTPServer2 getUser_id ' || qualified_name")}, '|') AS tokens FROM part_nodes""")
def q5_tokenize(spark, sf):
    return frame(spark, sf, "part_nodes").select("id", F.array_join(t.identifier_tokens(F.concat("docstring", F.lit("HTTPServer2 getUser_id "), "qualified_name")), "|").alias("tokens"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}]+')) AS token FROM documents) SELECT token, {_bucket_sql("token")} AS bucket FROM w""")
def q6_fnv_bucket(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), 0)).alias("token")).distinct()
    return words.select("token", t.fnv_bucket(F.col("token")).cast("int").alias("bucket"))


_EMBED = f"""tok AS (SELECT id, unnest(list_concat(list_concat(list_concat({_tokens_sql("name")}, {_tokens_sql("name")}), list_concat({_tokens_sql("name")}, {_tokens_sql("qualified_name")})), list_concat({_tokens_sql("signature")}, {_tokens_sql("docstring")}))) AS token FROM part_nodes),
cnt AS (SELECT id, {_bucket_sql("token")} AS dim, count(*) AS n FROM tok GROUP BY 1, 2),
vec AS (SELECT id, dim, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY id) AS DOUBLE)) AS w FROM cnt)"""
_QUERY_VECTOR = f"""qt AS (SELECT unnest({_tokens_sql("'green ring economy'")}) AS token), qc AS (SELECT {_bucket_sql("token")} AS dim, count(*) AS n FROM qt GROUP BY 1), qv AS (SELECT dim, n / sqrt(CAST(sum(n * n) OVER () AS DOUBLE)) AS w FROM qc)"""


@query(f"WITH {oracle('part_nodes')}, {_EMBED} SELECT id, CAST(dim AS INT) AS dim, round(w, 6) AS w FROM vec")
def q7_embed(spark, sf):
    return search.embed_nodes(frame(spark, sf, "part_nodes")).withColumn("w", F.round("w", 6))


@query(f"""WITH {oracle('part_nodes')}, {_EMBED}, {_QUERY_VECTOR}
SELECT id, round(sum(vec.w * qv.w), 6) AS score FROM vec JOIN qv USING (dim) GROUP BY id HAVING sum(vec.w * qv.w) > 0.05 ORDER BY round(sum(vec.w * qv.w), 9) DESC, id LIMIT 20""")
def q8_cosine_nodes(spark, sf):
    nodes = frame(spark, sf, "part_nodes")
    q = search.embed_text(spark.createDataFrame([("q", "green ring economy")], "id string, query string"), "query")
    scored = search.embed_nodes(nodes).join(F.broadcast(q.select("dim", F.col("w").alias("q"))), "dim").groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("q")), 9).alias("score"))
    return scored.filter(F.col("score") > t.COSINE_LEAST).orderBy(F.desc("score"), "id").limit(20).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q.e[i] AS DOUBLE))), 6) AS score FROM embeddings, q)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def q8_cosine_dense(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    scored = vectors.crossJoin(F.broadcast(q)).select("vec_id", F.round(t.dot(F.col("embedding"), F.col("q")), 6).alias("score"))  # one row
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


_RRF = """l AS (SELECT 'p' || p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), m AS (SELECT 'p' || p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part),
u AS (SELECT id, r FROM l WHERE r <= 200 UNION ALL SELECT id, r FROM m WHERE r <= 200)"""


@query(f"WITH {_RRF} SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM u GROUP BY id ORDER BY round(sum(1.0::DOUBLE / (60 + r)), 12) DESC, id LIMIT 100")
def q9_rrf(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), "p_partkey", "p_retailprice", "p_size")
    lists = [part.orderBy(F.desc(c), "p_partkey").limit(200).select("id", F.row_number().over(Window.orderBy(F.desc(c), "p_partkey")).alias("position")) for c in ("p_retailprice", "p_size")]
    return search.fuse(lists, 100).withColumn("score", F.round("score", 9))


@query(f"""WITH {oracle('part_nodes')}, {_EMBED}, {_QUERY_VECTOR.replace("green ring economy", "blue widgt economi")},
pool AS (SELECT * FROM part_nodes ORDER BY rank DESC, id LIMIT 5000),
x AS (SELECT id, name, {_trigrams_sql("name")} AS a, {_trigrams_sql("qualified_name")} AS b, {_trigrams_sql("'blue widgt economi'")} AS q FROM pool),
s AS (SELECT id, least(1.0, greatest({_similar_sql("a", "q")}, {_similar_sql("b", "q")})) AS score FROM x),
fz AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM s WHERE score > 0.15 ORDER BY score DESC, id LIMIT 20)),
cs AS (SELECT id, round(sum(vec.w * qv.w), 9) AS score FROM vec JOIN qv USING (dim) GROUP BY id),
vs AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM cs WHERE score > 0.05 ORDER BY score DESC, id LIMIT 20)),
u AS (SELECT * FROM fz UNION ALL SELECT * FROM vs), g AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score FROM u GROUP BY id)
SELECT id, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, id) AS INT) AS position FROM g ORDER BY round(score, 12) DESC, id LIMIT 10""")
def q10_smart_search(spark, sf):
    """A query that full text does not find, so trigrams and vectors are fused."""
    return search.smart_search(frame(spark, sf, "part_nodes"), "blue widgt economi", limit=10).withColumn("score", F.round("score", 9)).select("id", "score", "position")


_TERMS = """d AS (SELECT id, rank, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, qualified_name, signature, docstring)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM part_nodes),
t AS (SELECT id, rank, len(w) AS l, len(list_filter(w, lambda x: x = 'red')) AS a, len(list_filter(w, lambda x: x = 'widget')) AS b FROM d),
c AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t),
h AS (SELECT id, -(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m))) - 5 * rank AS score FROM t, c WHERE a > 0 AND b > 0)"""


def _neighbours_sql(of: str, k: int) -> str:
    other = "source" if of == "target" else "target"
    return f"""SELECT h.id, n.id AS other, row_number() OVER (PARTITION BY h.id ORDER BY e.confidence DESC, n.rank DESC, n.id) AS k FROM h JOIN part_edges e ON e.{of} = h.id JOIN part_nodes n ON n.id = e.{other} QUALIFY k <= {k}"""


def _sources(nodes):
    """A file of 1,100 lines, each the file's path, for every file of the nodes."""
    return nodes.select(F.col("file_path").alias("path")).distinct().withColumn("text", F.repeat(F.concat("path", F.lit("\n")), 1100))


@query(f"""WITH {oracle("part_nodes", "part_edges")}, {_TERMS.replace("WHERE a > 0 AND b > 0)", "WHERE a > 0 AND b > 0 ORDER BY score, id LIMIT 20)")},
up AS (SELECT id, string_agg(other, ',' ORDER BY k) AS callers FROM ({_neighbours_sql("target", 10)}) GROUP BY id),
down AS (SELECT id, string_agg(other, ',' ORDER BY k) AS callees FROM ({_neighbours_sql("source", 10)}) GROUP BY id)
SELECT h.id, callers, callees, CAST(least(60, end_line - start_line + 1) AS INT) AS n_lines FROM h JOIN part_nodes USING (id) LEFT JOIN up USING (id) LEFT JOIN down USING (id)""")
def q11_explore(spark, sf):
    nodes, edges = frame(spark, sf, "part_nodes"), frame(spark, sf, "part_edges")
    found = context.explore(edges, nodes, _sources(nodes), "red widget")["symbols"]
    return found.select("id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"), F.size("lines").alias("n_lines"))


@query(f"""WITH {oracle("part_nodes", "part_edges")}, {_TERMS.replace("WHERE a > 0 AND b > 0)", "WHERE a > 0 AND b > 0 ORDER BY score, id LIMIT 20)")}
SELECT DISTINCT source AS caller FROM part_edges JOIN h ON h.id = target ORDER BY caller LIMIT 30""")
def q11_blast_radius(spark, sf):
    nodes, edges = frame(spark, sf, "part_nodes"), frame(spark, sf, "part_edges")
    return context.explore(edges, nodes, _sources(nodes), "red widget")["blast_radius"]


@query(f"""WITH RECURSIVE {oracle("part_nodes", "part_edges")}, {_TERMS.replace("WHERE a > 0 AND b > 0)", "WHERE a > 0 AND b > 0 ORDER BY score, id LIMIT 16)")},
s AS (SELECT id, name, row_number() OVER (ORDER BY score, id) - 1 AS i FROM h JOIN part_nodes USING (id)),
every AS (SELECT id, 1000 - i AS priority, 'matches the query' AS reason, i, 0 AS part, 0 AS k FROM s
  UNION ALL SELECT other, 500 - i, 'called by ' || name, i, 1, k FROM ({_neighbours_sql("source", 8)}) x JOIN s USING (id)
  UNION ALL SELECT other, 300 - i, 'calls ' || name, i, 2, k FROM ({_neighbours_sql("target", 4)}) x JOIN s USING (id)),
one AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY i, part, k) = 1),
sized AS (SELECT id, reason, row_number() OVER (ORDER BY priority DESC, i, part, k, id) AS position, least(40, end_line - start_line + 1) AS m, strlen(file_path) AS p,
    strlen(qualified_name || ' ( ' || kind || ' ) ' || file_path || ':' || start_line) AS header FROM one JOIN part_nodes USING (id)),
priced AS (SELECT id, reason, position, CAST(ceil((m * p + m - 1) / 4.0) + ceil(header / 4.0) AS BIGINT) AS tokens FROM sized),
r AS (SELECT CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS used, false AS fits UNION ALL
  SELECT x.position, r.used + CASE WHEN r.used = 0 OR (r.used < 2000 AND r.used + x.tokens <= 2000) THEN x.tokens ELSE 0 END, r.used = 0 OR (r.used < 2000 AND r.used + x.tokens <= 2000) FROM r JOIN priced x ON x.position = r.position + 1)
SELECT id, reason, tokens, CAST(x.position AS INT) AS position FROM r JOIN priced x USING (position) WHERE fits""")
def q12_context_pack(spark, sf):
    nodes, edges = frame(spark, sf, "part_nodes"), frame(spark, sf, "part_edges")
    return context.pack(edges, nodes, _sources(nodes), "red widget", 2000).select("id", "reason", "tokens", "position")


@query(f"""WITH RECURSIVE {oracle("supply_nodes")}, i AS (SELECT id, nation, row_number() OVER (PARTITION BY nation ORDER BY rank DESC, id) AS position, strlen(qualified_name) * 7 AS tokens FROM supply_nodes),
r AS (SELECT DISTINCT nation, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS used, false AS fits FROM supply_nodes UNION ALL
  SELECT i.nation, i.position, r.used + CASE WHEN r.used = 0 OR (r.used < 1000 AND r.used + i.tokens <= 1000) THEN i.tokens ELSE 0 END, r.used = 0 OR (r.used < 1000 AND r.used + i.tokens <= 1000) FROM r JOIN i ON i.position = r.position + 1 AND i.nation = r.nation)
SELECT i.id, i.nation, CAST(i.position AS INT) AS position, i.tokens FROM r JOIN i USING (nation, position) WHERE r.fits""")
def w5_greedy_budget(spark, sf):
    """Of each nation's symbols, best first, those that fit."""
    nodes = frame(spark, sf, "supply_nodes")
    best = Window.partitionBy("nation").orderBy(F.desc("rank"), "id")
    items = nodes.select("id", "nation", F.row_number().over(best).alias("position"), (F.octet_length("qualified_name") * 7).alias("tokens"))
    return context.pack_greedily(items, 1000, "nation").select("id", "nation", "position", "tokens")
