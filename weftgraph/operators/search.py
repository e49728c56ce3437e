"""Search over nodes: full text, trigrams, hashed embeddings, and fused rankings."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Columns that full text looks at.
TEXT_COLUMNS = ("name", "qualified_name", "signature", "docstring")
FUZZY_POOL = 5_000


def postings(nodes: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """``term, id, tf``: the inverted index, with one partial sum per partition before its only shuffle."""
    have = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return nodes.select("id", F.explode(t.words(F.concat_ws(" ", *have))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def by_term(postings: DataFrame) -> DataFrame:
    """Postings laid out for storing: sorted by term, so that a reader's filter on terms skips most of a file."""
    return postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def by_dim(vectors: DataFrame) -> DataFrame:
    """Vectors laid out for storing: sorted by dimension, of which a query has few."""
    return vectors.repartitionByRange("dim", "id").sortWithinPartitions("dim", "id")


def parse_query(query: str) -> list[tuple[str, bool]]:
    """Terms of a query as (term, is a prefix): all must occur. Quoted phrases are taken word by word, ``term*`` is a prefix."""
    if query.count('"') % 2:
        raise ValueError("unbalanced quotation mark in query")
    if re.search(r"(^|\s)\*", query):
        raise ValueError("a prefix needs a term before its star")
    found = []
    for word in re.findall(r"[^\s\"]+", query.lower()):
        parts = re.findall(r"[^\W_]+", word)
        found += [(p, word.endswith("*") and k == len(parts) - 1) for k, p in enumerate(parts)]
    if not found:
        raise ValueError("empty query")
    return list(dict.fromkeys(found))


def full_text(nodes: DataFrame, query: str, kind: str | None = None, limit: int | None = 20, columns: tuple[str, ...] = TEXT_COLUMNS, postings: DataFrame | None = None) -> DataFrame:
    """``id, score``: nodes that hold all terms, by BM25 less a bonus of 5 times the rank (smaller is better).

    With stored ``postings`` (of :func:`postings`) only those of the query's terms are read,
    and lengths are sums of a narrow column. Without, nodes are tokenized in the scan; only
    terms of the query are exploded, so what is shuffled follows the hits and not the text.
    Corpus figures (count, mean length, document frequencies) are one-row aggregates joined in.
    """
    terms = parse_query(query)
    have = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    is_term = lambda w, p, prefix: F.startswith(w, F.lit(p)) if prefix else w == p
    of = lambda w: F.coalesce(*[F.when(is_term(w, p, prefix), F.lit(k)) for k, (p, prefix) in enumerate(terms)])
    tfs = [f"tf{k}" for k in range(len(terms))]
    if postings is not None:
        any_term = functools.reduce(operator.or_, [is_term(F.col("term"), p, prefix) for p, prefix in terms])
        hits = postings.filter(any_term).withColumn("k", of(F.col("term"))).groupBy("id").agg(*[F.sum(F.when(F.col("k") == k, F.col("tf")).otherwise(0)).alias(c) for k, c in enumerate(tfs)])
        total = postings.agg(F.sum("tf").alias("total"))
        corpus = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(total).select("n", (F.col("total") / F.col("n")).alias("mean"))
        counted = hits.agg(*[F.count_if(F.col(c) > 0).alias(f"df{k}") for k, c in enumerate(tfs)])
        corpus = corpus.crossJoin(counted)  # rows of one each
        found = hits.filter(functools.reduce(operator.and_, [F.col(c) > 0 for c in tfs]))
        lengths = postings.join(found.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("tf").alias("length"))
        found = found.join(lengths, "id").join(nodes.select("id", "kind", "rank"), "id")
    else:
        all_words = t.words(F.concat_ws(" ", *have))
        docs = nodes.select("id", "kind", "rank", all_words.alias("words")).select("id", "kind", "rank", F.size("words").alias("length"), F.filter(F.transform("words", of), lambda k: k.isNotNull()).alias("hits"))
        docs = docs.select("id", "kind", "rank", "length", *[(F.size("hits") - F.size(F.array_remove("hits", k))).alias(c) for k, c in enumerate(tfs)])
        corpus = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(c) > 0).alias(f"df{k}") for k, c in enumerate(tfs)])
        found = docs.filter(functools.reduce(operator.and_, [F.col(c) > 0 for c in tfs]))
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    score = F.lit(0.0)
    for k, c in enumerate(tfs):
        score = score + t.bm25_part(F.col(c), F.col("length"), F.col("mean"), F.col("n"), F.col(f"df{k}"))
    ranked = found.crossJoin(F.broadcast(corpus)).select("id", (-score - t.RANK_WEIGHT * F.col("rank")).alias("score"))  # one row
    ranked = ranked.orderBy("score", "id")
    return ranked.limit(limit) if limit is not None else ranked


def fuzzy(nodes: DataFrame, query: str, limit: int = 20, pool: int = FUZZY_POOL) -> DataFrame:
    """``id, score`` of the best trigram matches among the ``pool`` nodes of highest rank."""
    top = nodes.filter(F.col("kind") != "file").orderBy(F.desc("rank"), "id").limit(pool)
    scored = top.select("id", t.fuzzy_score(F.lit(query), F.col("name"), F.col("qualified_name")).alias("score"))
    return scored.filter(F.col("score") > t.FUZZY_LEAST).orderBy(F.desc("score"), "id").limit(limit)


def embed_nodes(nodes: DataFrame) -> DataFrame:
    """``id, dim, w``: unit vectors of hashed identifier tokens, the name counting three times, as sparse rows."""
    every = F.concat(*[t.identifier_tokens(F.col(c)) for c in ("name", "name", "name", "qualified_name", "signature", "docstring")])
    return _unit(nodes.select("id", F.explode(every).alias("token")))


def embed_text(df: DataFrame, column: str) -> DataFrame:
    return _unit(df.select("id", F.explode(t.identifier_tokens(F.col(column))).alias("token")))


def _unit(tokens: DataFrame) -> DataFrame:
    sums = tokens.groupBy("id", t.fnv_bucket(F.col("token")).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    norm = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return sums.join(norm, "id").select("id", "dim", (F.col("n") / F.col("norm")).alias("w"))


def cosine_search(vectors: DataFrame, query: DataFrame, limit: int = 20) -> DataFrame:
    """``id, score`` of sparse unit vectors against one query vector (``dim, w``, at most 256 rows, broadcast)."""
    q = F.broadcast(query.select("dim", F.col("w").alias("q")))
    scored = vectors.join(q, "dim").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))
    return scored.filter(F.col("score") > t.COSINE_LEAST).orderBy(F.desc("score"), "id").limit(limit)


def vector_search(nodes: DataFrame, query: str, limit: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """Best nodes for a query by cosine, of stored ``vectors`` (whose dimensions that the query has are read) or of vectors made anew."""
    q = embed_text(nodes.sparkSession.createDataFrame([("q", query)], "id string, query string"), "query")
    if vectors is not None:
        dims = [r["dim"] for r in q.select("dim").collect()]  # 256 at most
        vectors = vectors.filter(F.col("dim").isin(dims))
    return cosine_search(vectors if vectors is not None else embed_nodes(nodes), q, limit)


def ranked(df: DataFrame, *order) -> DataFrame:
    """``id, position`` of a short ranked list."""
    return df.select("id", F.row_number().over(Window.orderBy(*order)).alias("position"))


def fuse(lists: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists with ``id, position`` (from 1): ``id, score``, best first, ties by id."""
    every = lists[0].select("id", "position")
    for other in lists[1:]:
        every = every.unionAll(other.select("id", "position"))
    out = every.groupBy("id").agg(F.sum(F.lit(1.0) / (t.RRF_K + F.col("position"))).alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit is not None else out


def smart_search(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20, postings: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Full text if it finds anything, else trigrams and vectors fused; ``id, score, position``. Malformed queries raise.

    Stored ``postings`` and ``vectors`` are used where given.
    """
    hits = full_text(nodes, query, kind, limit, postings=postings)
    if not hits.isEmpty():
        return hits.withColumn("position", F.row_number().over(Window.orderBy("score", "id")))
    near = ranked(fuzzy(nodes, query, 2 * limit), F.desc("score"), "id")
    alike = ranked(vector_search(nodes, query, 2 * limit, vectors), F.desc("score"), "id")
    fused = fuse([near, alike], 2 * limit)
    if kind is not None:
        fused = fused.join(nodes.filter(F.col("kind") == kind).select("id"), "id", "left_semi")
    fused = fused.orderBy(F.desc("score"), "id").limit(limit)
    return fused.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
