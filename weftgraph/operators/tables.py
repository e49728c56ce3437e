"""Relational operators on the index tables: lookups, counts, upserts, deletions, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the numbers of files, nodes and edges."""
    one = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((files, "files"), (nodes, "nodes"), (edges, "edges"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def lookup(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes whose name or qualified name is among ``target_name``; two semi joins rather than a disjunction."""
    names = names.select("target_name").distinct()
    by_name = nodes.join(names, nodes["name"] == names["target_name"], "left_semi")
    by_qualified = nodes.join(names, nodes["qualified_name"] == names["target_name"], "left_semi")
    return by_name.unionByName(by_qualified.join(names, by_qualified["name"] == names["target_name"], "left_anti"))


def nodes_in_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") == path).orderBy("start_line", "id")


def top_nodes(nodes: DataFrame, limit: int) -> DataFrame:
    return nodes.filter(F.col("kind") != "file").orderBy(F.desc("rank"), "id").limit(limit)


def changed(fresh: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """Fresh rows that are unknown or whose ``content_hash`` differs."""
    before = known.select(key, F.col("content_hash").alias("known_hash"))
    return fresh.join(before, key, "left").filter(F.col("known_hash").isNull() | (F.col("known_hash") != F.col("content_hash"))).drop("known_hash")


def pruned(known: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    return known.join(fresh.select(key), key, "left_anti")


def stale(known: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Known rows whose file is gone or has another hash. What is not known is not stale."""
    now = fresh.select(key, F.col("content_hash").alias("fresh_hash"))
    return known.join(now, key, "left").filter(F.col("fresh_hash").isNull() | (F.col("fresh_hash") != F.col("content_hash"))).drop("fresh_hash")


def parse_issues(files: DataFrame, key: str = "path") -> DataFrame:
    total = F.col("parse_errors") + F.col("parse_missing")
    return files.filter(total > 0).orderBy(F.desc(total), key)


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest ``order`` of each key. A maximum of structs, so that partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, fixed: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the last row of each key of ``new``; columns in ``fixed`` keep the old value where there is one."""
    fresh = last_of(new, keys, order).select(*old.columns)
    kept = old.join(fresh.select(*keys), keys, "left_anti")
    if fixed:
        before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in fixed])
        fresh = fresh.join(before, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fixed else F.col(c) for c in old.columns])
    return kept.unionByName(fresh)


def scored_edges(rows: DataFrame, order: str) -> DataFrame:
    """Edges as a set on (source, target, kind) with the confidence that came last."""
    return rows.groupBy("source", "target", "kind").agg(F.max_by("confidence", order).alias("confidence"))


def delete_files(nodes: DataFrame, edges: DataFrame, refs: DataFrame | None, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Tables without files: their nodes, edges at either end, and references go too. ``files`` has ``file_path``."""
    gone = nodes.join(files, "file_path", "left_semi").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(files, "file_path", "left_anti"), kept, refs.join(files, "file_path", "left_anti") if refs is not None else None


def union_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by key that prefers earlier frames; ``first`` tells which frame a row came from."""
    every = frames[0].withColumn("first", F.lit(0))
    for k, df in enumerate(frames[1:], 1):
        every = every.unionByName(df.withColumn("first", F.lit(k)))
    w = Window.partitionBy(*keys).orderBy("first")
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
