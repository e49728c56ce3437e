"""The relational tables seen as nodes, edges, references, commits and lines.

Each projection is one SQL text in the dialect that Spark and the oracle share; tables are
written in braces. The operators then work on frames alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    # Customers call suppliers they buy from, with a confidence by revenue.
    "supply_edges": """
        SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, 'calls' AS kind,
               round(CAST(cents AS DOUBLE) / max(CAST(cents AS DOUBLE)) OVER (), 6) AS confidence
        FROM (SELECT o_custkey, l_suppkey, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
              FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey) g""",
    "supply_nodes": """
        SELECT 'c' || c_custkey AS id, 'function' AS kind, c_name AS name, c_mktsegment || '::' || c_name AS qualified_name,
               'customers/n' || c_nationkey || '/' || c_mktsegment || '.rs' AS file_path, c_mktsegment AS language, round(c_acctbal / 10000, 6) AS rank, c_nationkey AS nation
        FROM {customer}
        UNION ALL
        SELECT 's' || s_suppkey, 'method', s_name, 'SUPPLY::' || s_name,
               'suppliers/n' || s_nationkey || '/supply.rs', 'SUPPLY', round(s_acctbal / 10000, 6), s_nationkey
        FROM {supplier}""",
    # A part calls the two parts that most often follow it in an order.
    "part_edges": """
        SELECT 'p' || a AS source, 'p' || b AS target, 'calls' AS kind, CAST(1 AS DOUBLE) AS confidence
        FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k
              FROM (SELECT a, b, count(*) AS n
                    FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM {lineitem}) l
                    WHERE b IS NOT NULL AND a <> b GROUP BY a, b) c) t
        WHERE k <= 2""",
    "part_nodes": """
        SELECT 'p' || p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'struct' WHEN 1 THEN 'class' WHEN 2 THEN 'method' ELSE 'function' END AS kind,
               p_name || ' ' || CAST(p_size % 10 AS STRING) AS name, p_brand || '::' || p_name || '::' || p_partkey AS qualified_name,
               'src/' || lower(p_type) || '/brand_' || substr(p_brand, 7) || '.rs' AS file_path, lower(p_type) AS language,
               CAST(p_partkey % 997 AS INT) + 1 AS start_line, CAST(p_partkey % 997 AS INT) + p_size AS end_line,
               p_type AS signature, p_name || ' of ' || p_brand AS docstring, p_size % 4 = 0 AS is_exported, round(CAST(p_size AS DOUBLE) / 50, 6) AS rank, p_brand AS brand
        FROM {part}""",
    "commits": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS commit, 's' || l_suppkey AS file FROM {lineitem}",
    "corpus": """
        SELECT 'd' || doc_id AS id, lang AS kind, source AS name, source || '::' || doc_id AS qualified_name, CAST(NULL AS STRING) AS signature,
               text AS docstring, round(CAST(doc_id % 7 AS DOUBLE) / 10, 6) AS rank
        FROM {documents}""",
    # Brands are classes that contain their parts.
    "brand_nodes": "SELECT DISTINCT 'b' || p_brand AS id, 'class' AS kind, p_brand AS name, p_brand AS qualified_name, 'src/brands.rs' AS file_path FROM {part}",
    "contains_edges": "SELECT 'b' || p_brand AS source, 'p' || p_partkey AS target, 'contains' AS kind, CAST(1 AS DOUBLE) AS confidence FROM {part}",
    # Every order refers to some part by name, from some part.
    "refs": """
        SELECT o_orderkey AS ref_id, 'p' || p.p_partkey AS source_node_id,
               CASE WHEN o_orderkey % 9 = 0 THEN 'crate::brand_' || CAST(o_custkey % 25 AS STRING) ELSE q.p_name || ' ' || CAST(q.p_size % 10 AS STRING) END AS target_name,
               CASE WHEN o_orderkey % 9 = 0 THEN 'imports' WHEN o_orderkey % 7 = 0 THEN 'extends' WHEN o_orderkey % 5 = 0 THEN 'instantiates' WHEN o_orderkey % 11 = 0 THEN 'references' ELSE 'calls' END AS kind,
               'src/' || lower(p.p_type) || '/brand_' || substr(p.p_brand, 7) || '.rs' AS file_path,
               CASE WHEN o_orderkey % 8 = 1 THEN '!' || q.p_brand WHEN o_orderkey % 8 = 2 THEN 'Self' WHEN o_orderkey % 8 = 3 THEN '!Nowhere' END AS receiver_hint
        FROM {orders} JOIN {part} p ON p.p_partkey = o_custkey JOIN {part} q ON q.p_partkey = (o_orderkey * 7) % (o_custkey + 100)""",
    # Parts also say that their brand extends another.
    "base_refs": """
        SELECT 1000000000 + CAST(substr(p_brand, 7) AS BIGINT) AS ref_id, 'b' || p_brand AS source_node_id,
               'Brand#' || CAST(CAST(substr(p_brand, 7) AS BIGINT) % 25 + 1 AS STRING) AS target_name,
               'extends' AS kind, 'src/brands.rs' AS file_path, CAST(NULL AS STRING) AS receiver_hint
        FROM (SELECT DISTINCT p_brand FROM {part}) b""",
    "changes": "SELECT event_id, 'src/u' || user_id || '.rs' AS path, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'update' END AS op, ts, value FROM {events}",
    "log_lines": """
        SELECT CAST(floor(event_id / 500) AS BIGINT) AS log, event_id AS line_no,
               CASE WHEN event_type = 'signup' OR event_id % 500 = 0 THEN '@' || event_id WHEN event_type = 'error' THEN '' ELSE 'src/u' || user_id || '.rs' END AS text
        FROM {events}""",
    "hunks": """
        SELECT o_orderkey AS hunk, 'src/f' || (o_custkey % 50) || '.rs' AS file_path,
               '@@ -' || (o_custkey % 300 + 1) || ',2 +' || (o_custkey % 400 + 1) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',' || (o_orderkey % 6) END || ' @@ fn x' AS header
        FROM {orders}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **used)


def oracle(*names: str) -> str:
    """The projections as a list of common table expressions for the oracle."""
    return ",\n".join(f"{n} AS MATERIALIZED ({re.sub(r'{(\w+)}', r'\1', SQL[n])})" for n in names)
