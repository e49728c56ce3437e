"""One query per training-data operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_extract, lang_id, license_scan, ngram_join, packing, pii, sharding, token_counts
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand at source/thousand of ids/id.txt, the tree that licences are inherited along."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.licenses(docs.withColumn("path", path), keep=("doc_id",))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_sharding, op3_pii, op4_html, op5_ann, op6_ngram_join, op7_packing, op8_license, op9_decontamination, op10_lang_id)
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    # Binary search (find), greedy cuts and a table-driven CRC-32, each as a recursion or a fold.
    "op2_sharding": """
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
s AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT place, doc_id, strlen(t) + 1 AS size, (CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) - 576460752303423488) * 16 AS key,
      xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM s, tab),
g AS (SELECT key, sum(size) AS b FROM d GROUP BY key),
p AS (SELECT key, CAST(sum(b) OVER (ORDER BY key) AS BIGINT) AS e, CAST(b AS BIGINT) AS b FROM g),
tot AS (SELECT max(e) AS total, max(b) AS most FROM p),
find AS (
  SELECT greatest(CAST(ceil(total / 8.0) AS BIGINT), most) AS lo, total AS hi, 0 AS k, CAST(0 AS BIGINT) AS pos FROM tot
  UNION ALL
  SELECT CASE WHEN k < 7 AND nat < total OR nat = total THEN lo ELSE mid + 1 END, CASE WHEN nat = total THEN mid ELSE hi END,
         CASE WHEN nat = total OR k = 7 THEN 0 ELSE k + 1 END, CASE WHEN nat = total OR k = 7 THEN 0 ELSE nat END
  FROM (SELECT f.lo, f.hi, f.k, (f.lo + f.hi) // 2 AS mid, tot.total, max(p.e) AS nat FROM find f, tot, p WHERE f.lo < f.hi AND p.e <= f.pos + (f.lo + f.hi) // 2 GROUP BY ALL)),
best AS (SELECT lo AS c FROM find WHERE lo = hi LIMIT 1),
cut AS (SELECT CAST(0 AS BIGINT) AS pos, 0 AS k UNION ALL SELECT max(p.e), cut.k + 1 FROM cut, best, p WHERE cut.k < 7 AND p.e <= cut.pos + best.c GROUP BY cut.k),
sh AS (SELECT p.key, CAST(count(cut.pos) AS INT) AS shard FROM p LEFT JOIN cut ON cut.k > 0 AND cut.pos < p.e GROUP BY p.key)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM d JOIN sh USING (key)
""",
    "op9_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS m, array_to_string(w[k + 1 : k + least(len(w), 10)], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS k FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT rid, m, k, array_to_string(w[k + 1 : k + m], ' ') AS win
       FROM (SELECT rid, w, m, unnest(range(0, len(w) - m + 1)) AS k FROM d, ms WHERE len(w) >= m)),
h AS (SELECT dw.rid, dw.k, dw.m, iw.item FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + m)) AS pos FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
""",
    "op6_ngram_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT rid, CASE WHEN len(w) = 0 THEN 'text ' || text ELSE 'words ' || array_to_string(w[k + 1 : k + least(len(w), 5)], ' ') END AS gram
      FROM (SELECT rid, text, w, unnest(range(0, greatest(len(w) - 4, 1))) AS k FROM d WHERE text IS NOT NULL)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM c JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT r.x, min(d.doc_id) AS class_id, count(*) AS n_class FROM r JOIN d ON d.rid = r.y GROUP BY r.x)
SELECT d.doc_id, k.class_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_links, k.n_class
FROM d JOIN k ON k.x = d.rid LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) z ON z.x = d.rid
""",
}
