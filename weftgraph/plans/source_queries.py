"""Queries over sources, exports, pages and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..sources import export, gitlog, lines, web
from ..streaming import watch
from .projections import frame, oracle
from .registry import query


@query(f"""WITH {oracle("log_lines")}, n AS (SELECT *, sum(CASE WHEN text LIKE '@%' THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY line_no) AS commit_no FROM log_lines),
h AS (SELECT log, commit_no, substr(text, 2) AS commit FROM n WHERE text LIKE '@%')
SELECT n.log, CAST(n.commit_no AS BIGINT) AS commit_no, h.commit, n.text AS file FROM n JOIN h ON h.log = n.log AND h.commit_no = n.commit_no WHERE n.text <> '' AND n.text NOT LIKE '@%'""")
def s9_log_parse(spark, sf):
    return gitlog.parse_log(frame(spark, sf, "log_lines"))


@query(f"""WITH {oracle("hunks")} SELECT DISTINCT file_path, CAST(unnest(range(s, s + greatest(1, coalesce(c, 1)))) AS INT) AS line FROM (SELECT file_path, CAST(regexp_extract(header, '\\+(\\d+)', 1) AS INT) AS s, TRY_CAST(nullif(regexp_extract(header, '\\+\\d+,(\\d+)', 1), '') AS INT) AS c FROM hunks)""")
def s11_hunk_lines(spark, sf):
    return gitlog.changed_lines(frame(spark, sf, "hunks")).select("file_path", F.col("line").cast("int").alias("line"))


@query(r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents) SELECT doc_id, array_to_string(l[2:4], '|') AS body FROM d""")
def s12_line_slice(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.array_join(lines.slice_lines(F.col("text"), F.lit(2), F.lit(4)), "|").alias("body"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(len(l)) AS BIGINT) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def s12_line_counts(spark, sf):
    every = lines.as_lines(spark.read.parquet(f"{sf}/documents.parquet"), "text", "doc_id")
    return every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query(r"""WITH p AS (SELECT page_id, 'src/x.' || CASE page_id % 7 WHEN 0 THEN 'rs' WHEN 1 THEN 'pyi' WHEN 2 THEN 'h' WHEN 3 THEN 'hh' WHEN 4 THEN 'vue' WHEN 5 THEN 'md' ELSE 'c' END AS path,
 CASE WHEN page_id % 2 = 0 THEN 'class X' ELSE 'int x;' END AS body FROM pages)
SELECT page_id, CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.pyi' THEN 'python' WHEN path LIKE '%.h' THEN CASE WHEN body LIKE '%class %' THEN 'cpp' ELSE 'c' END WHEN path LIKE '%.hh' THEN 'cpp' WHEN path LIKE '%.vue' THEN 'vue' WHEN path LIKE '%.c' THEN 'c' END AS language FROM p""")
def s4_s5_language(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("rs", "pyi", "h", "hh", "vue", "md", "c"))), (F.col("page_id") % 7 + 1).cast("int"))
    path, body = F.concat(F.lit("src/x."), ext), F.when(F.col("page_id") % 2 == 0, "class X").otherwise("int x;")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", paths.refined_language(paths.language(path), path, body).alias("language"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/target/x.rs' WHEN 1 THEN 'a/targets/x.rs' WHEN 2 THEN '.git/x.rs' ELSE 'node_modules' END AS path FROM pages)
SELECT page_id, regexp_matches('/' || path, '/(\.git|node_modules|target|dist|build)/') AS ignored FROM p""")
def s3_ignored(spark, sf):
    path = F.concat(F.lit("/"), F.element_at(F.array(*map(F.lit, ("a/target/x.rs", "a/targets/x.rs", ".git/x.rs", "node_modules"))), (F.col("page_id") % 4 + 1).cast("int")))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", paths.ignored(path).alias("ignored"))


@query(r"""SELECT page_id, CAST(unnest(range(len(bodies))) AS INT) AS block, unnest(bodies) AS body FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS bodies FROM pages)""")
def e14_script_blocks(spark, sf):
    return web.script_blocks(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "block", "body")


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) AS link FROM pages)
SELECT DISTINCT page_id, CASE WHEN regexp_matches(link, '^[a-z]+://') THEN link WHEN link LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || link END AS target FROM l""")
def page_links(spark, sf):
    return web.links(spark.read.parquet(f"{sf}/pages.parquet"))


@query(f"""WITH {oracle("supply_edges", "part_nodes")}
SELECT to_json({{'id': id, 'kind': kind, 'name': name, 'qualified_name': qualified_name, 'file_path': file_path, 'language': language, 'start_line': start_line, 'end_line': end_line, 'signature': signature, 'docstring': docstring, 'is_exported': is_exported}})::VARCHAR AS line FROM part_nodes
UNION ALL SELECT to_json({{'source': source, 'target': target, 'kind': kind}})::VARCHAR FROM supply_edges""")
def k13_export_json(spark, sf):
    nodes = frame(spark, sf, "part_nodes")
    columns = tuple(c for c in export.NODE_COLUMNS if c in nodes.columns)
    return export.json_lines(nodes, columns).unionByName(export.json_lines(frame(spark, sf, "supply_edges"), export.EDGE_COLUMNS))


@query(f"""WITH {oracle("part_nodes", "part_edges")} SELECT '  "' || id || '" [label="' || kind || ' ' || replace(replace(name, '\\', '\\\\'), '"', '\\"') || '"];' AS line FROM (SELECT id, kind, name || ' "q" \\ z' AS name FROM part_nodes)
UNION ALL SELECT '  "' || source || '" -> "' || target || '" [label="calls"];' FROM part_edges""")
def k14_export_dot(spark, sf):
    nodes = frame(spark, sf, "part_nodes").withColumn("name", F.concat("name", F.lit(' "q" \\ z')))
    return export.dot_lines(nodes, frame(spark, sf, "part_edges"))


@query("""SELECT doc_id || ',' || source || ',' || CASE WHEN contains(t, ',') OR contains(t, '"') OR contains(t, chr(10)) OR contains(t, chr(13)) THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS line FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)""")
def k15_export_csv(spark, sf):
    return export.csv_lines(spark.read.parquet(f"{sf}/documents.parquet"), ("doc_id", "source", "text"))


def _lsif_sql() -> str:
    """Every line from its file's base number and the symbol's place in the file."""
    line = lambda **c: "to_json({" + ", ".join(f"'{k}': {v}" for k, v in c.items()) + "})::VARCHAR"
    place = lambda c: f"{{'line': greatest({c} - 1, 0), 'character': 0}}"
    parts = [
        line(id="pos", type="'vertex'", label="'range'", start=place("start_line"), end=place("end_line")),
        line(id="pos + 1", type="'vertex'", label="'resultSet'"),
        line(id="pos + 2", type="'edge'", label="'next'", outV="pos", inV="pos + 1"),
        line(id="pos + 3", type="'vertex'", label="'hoverResult'", result="{'contents': [coalesce(signature, qualified_name)]}"),
        line(id="pos + 4", type="'edge'", label="'textDocument/hover'", outV="pos + 1", inV="pos + 3"),
        line(id="pos + 5", type="'edge'", label="'contains'", outV="base", inVs="[pos]"),
    ]
    symbols = " UNION ALL ".join(f"SELECT CAST(pos + {k} AS BIGINT) AS n, {x} AS line FROM placed" for k, x in enumerate(parts))
    return f"""WITH {oracle("part_nodes")}, f AS (SELECT file_path, min(language) AS language, count(*) AS n, row_number() OVER (ORDER BY file_path) AS f FROM part_nodes GROUP BY file_path),
b AS (SELECT file_path, language, CAST(2 * f + 1 + 7 * (sum(n) OVER (ORDER BY f) - n) AS BIGINT) AS base FROM f),
placed AS (SELECT p.*, base, base + 1 + 7 * (row_number() OVER (PARTITION BY p.file_path ORDER BY start_line, id) - 1) AS pos FROM part_nodes p JOIN b ON b.file_path = p.file_path)
SELECT CAST(1 AS BIGINT) AS n, '{{"id": 1, "type": "vertex", "label": "metaData", "version": "0.4.3", "positionEncoding": "utf-16"}}' AS line
UNION ALL SELECT 2, '{{"id": 2, "type": "vertex", "label": "project"}}'
UNION ALL SELECT base, {line(id="base", type="'vertex'", label="'document'", uri="'file://' || file_path", languageId="language")} FROM b
UNION ALL {symbols}"""


@query(_lsif_sql())
def k16_export_lsif(spark, sf):
    nodes = frame(spark, sf, "part_nodes")
    return export.lsif_vertices(nodes)


@query(f"""WITH {oracle("changes")}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM changes WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
n AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g)
SELECT path, min(ts) AS start, count(*) AS n FROM n GROUP BY path, burst""")
def st1_debounce(spark, sf):
    return watch.debounced(frame(spark, sf, "changes"), "1 hour").select("path", "start", "n")


@query(f"""WITH {oracle("changes")}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM changes WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
n AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g)
SELECT path, CAST(burst AS BIGINT) AS burst, count(*) AS n, min(ts) AS first, max(ts) AS last FROM n GROUP BY path, burst""")
def st1_bursts(spark, sf):
    return watch.islands(frame(spark, sf, "changes"), 3600)


@query(f"""WITH {oracle("changes")} SELECT path, op FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS n FROM changes) WHERE n = 1""")
def st2_collapse(spark, sf):
    return watch.collapsed(frame(spark, sf, "changes"), ("ts", "event_id")).select("path", "op")


@query("""WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/p/src/main.rs' WHEN 1 THEN '/p/target/debug/main.rs' WHEN 2 THEN '/p/.git/config' WHEN 3 THEN '/p/README.md' ELSE '/p/a.vue' END AS path FROM events) SELECT event_id, path FROM p WHERE event_id % 5 IN (0, 4)""")
def st4_relevant(spark, sf):
    path = F.element_at(F.array(*map(F.lit, ("/p/src/main.rs", "/p/target/debug/main.rs", "/p/.git/config", "/p/README.md", "/p/a.vue"))), (F.col("event_id") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", path.alias("path")).filter(watch.relevant(F.col("path")))


@query(f"""WITH {oracle("changes")} SELECT path, value FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS n FROM changes) WHERE n = 1 AND op = 'update'""")
def st3_incremental_state(spark, sf):
    """The state after three batches of changes, each upserted and deleted in turn, is that of the last change of each path."""
    from ..operators.tables import last_of

    changes = frame(spark, sf, "changes")
    top = changes.agg(F.max("event_id")).first()[0] or 0
    state = None
    for k in range(3):
        batch = last_of(changes.filter(F.floor(F.col("event_id") * 3 / (top + 1)) == k), ["path"], "event_id")
        kept = batch.filter("op = 'update'").select("path", "value")
        state = kept if state is None else state.join(batch.select("path"), "path", "left_anti").unionByName(kept)
    return state
