"""Graphs as JSON, DOT, CSV and LSIF; lines are made by expressions and written by Spark."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import numbered

NODE_COLUMNS = ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "signature", "docstring", "visibility", "is_exported", "is_async", "is_static", "is_abstract")
EDGE_COLUMNS = ("source", "target", "kind")
FORMATS = ("json", "dot", "csv", "lsif")


def csv_field(c: Column) -> Column:
    """A field, in quotes only if it holds a comma, a quote or a line feed."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"))


def dot_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge statements of a DOT graph, without its frame."""
    n = nodes.select(F.concat(F.lit('  "'), dot_text(F.col("id")), F.lit('" [label="'), dot_text(F.concat_ws(" ", "kind", "name")), F.lit('"];')).alias("line"))
    e = edges.select(F.concat(F.lit('  "'), dot_text(F.col("source")), F.lit('" -> "'), dot_text(F.col("target")), F.lit('" [label="'), dot_text(F.col("kind")), F.lit('"];')).alias("line"))
    return n.unionByName(e)


def json_lines(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("line"))


def lsif_vertices(nodes: DataFrame) -> DataFrame:
    """Numbered LSIF lines: metadata, project, and per file its document, per symbol its range, result set, hover and edges.

    Ids are computed from ranks (a stride of 7 per symbol and 2 per file), not from a running counter.
    """
    files = nodes.select("file_path", "language").groupBy("file_path").agg(F.min("language").alias("language"))
    symbols = nodes.filter(F.col("kind") != "file").withColumn("s", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id")))
    before = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    files = numbered(files.join(before, "file_path", "left"), "file_path", "n").withColumn("base", 2 * F.col("number") + 1 + 7 * F.col("before"))
    json_of = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    lit = F.lit
    docs = files.select(F.col("base").alias("n"), json_of(id=F.col("base"), type=lit("vertex"), label=lit("document"), uri=F.concat(lit("file://"), F.col("file_path")), languageId=F.col("language")).alias("line"))
    placed = symbols.join(files.select("file_path", "base"), "file_path").withColumn("at", F.col("base") + 1 + 7 * (F.col("s") - 1))
    at = F.col("at")
    place = lambda line: F.struct((F.greatest(F.col(line) - 1, lit(0))).alias("line"), lit(0).alias("character"))
    hover = F.struct(F.array(F.coalesce("signature", "qualified_name")).alias("contents"))
    parts = F.array(
        F.struct(at.alias("n"), json_of(id=at, type=lit("vertex"), label=lit("range"), start=place("start_line"), end=place("end_line")).alias("line")),
        F.struct((at + 1).alias("n"), json_of(id=at + 1, type=lit("vertex"), label=lit("resultSet")).alias("line")),
        F.struct((at + 2).alias("n"), json_of(id=at + 2, type=lit("edge"), label=lit("next"), outV=at, inV=at + 1).alias("line")),
        F.struct((at + 3).alias("n"), json_of(id=at + 3, type=lit("vertex"), label=lit("hoverResult"), result=hover).alias("line")),
        F.struct((at + 4).alias("n"), json_of(id=at + 4, type=lit("edge"), label=lit("textDocument/hover"), outV=at + 1, inV=at + 3).alias("line")),
        F.struct((at + 5).alias("n"), json_of(id=at + 5, type=lit("edge"), label=lit("contains"), outV=F.col("base"), inVs=F.array(at)).alias("line")),
    )
    head = nodes.sparkSession.createDataFrame([(1, json.dumps({"id": 1, "type": "vertex", "label": "metaData", "version": "0.4.3", "positionEncoding": "utf-16"})), (2, json.dumps({"id": 2, "type": "vertex", "label": "project"}))], "n bigint, line string")
    return head.unionByName(docs.select(F.col("n").cast("bigint").alias("n"), "line")).unionByName(placed.select(F.explode(parts).alias("x")).select(F.col("x.n").cast("bigint").alias("n"), "x.line"))


def save(nodes: DataFrame, edges: DataFrame, folder: str, form: str = "json") -> None:
    """Writes a graph of any size as text files of lines, nodes and edges in folders of their own (LSIF and DOT in one); no line comes to the driver."""
    if form not in FORMATS:
        raise ValueError(f"unknown export format: {form}")
    columns = tuple(c for c in NODE_COLUMNS if c in nodes.columns)
    if form == "lsif":
        lsif_vertices(nodes).orderBy("n").select("line").write.mode("overwrite").text(folder)
    elif form == "dot":
        dot_lines(nodes, edges).write.mode("overwrite").text(folder)
    else:
        lines = json_lines if form == "json" else csv_lines
        lines(nodes, columns).write.mode("overwrite").text(f"{folder}/nodes")
        lines(edges, EDGE_COLUMNS).write.mode("overwrite").text(f"{folder}/edges")


def render(nodes: DataFrame, edges: DataFrame, form: str = "json") -> str:
    """One text of a graph that fits on the driver; unknown forms raise. :func:`save` writes larger ones."""
    if form not in FORMATS:
        raise ValueError(f"unknown export format: {form}")
    lines = lambda df: [r["line"] for r in df.collect()]
    nodes, edges = nodes.orderBy("file_path", "start_line", "id"), edges.orderBy("source", "target", "kind")
    columns = tuple(c for c in NODE_COLUMNS if c in nodes.columns)
    if form == "json":
        return json.dumps({"nodes": [json.loads(x) for x in lines(json_lines(nodes, columns))], "edges": [json.loads(x) for x in lines(json_lines(edges, EDGE_COLUMNS))]}, indent=2, ensure_ascii=False)
    if form == "dot":
        return "\n".join(["digraph code {", *lines(dot_lines(nodes, edges)), "}"]) + "\n"
    if form == "lsif":
        return "\n".join(r["line"] for r in lsif_vertices(nodes).orderBy("n").collect()) + "\n"
    return "\n".join([",".join(columns), *lines(csv_lines(nodes, columns)), "", ",".join(EDGE_COLUMNS), *lines(csv_lines(edges, EDGE_COLUMNS))]) + "\n"


def read_csv_sections(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges back from the CSV form."""
    first, _, second = text.partition(f"\n\n{','.join(EDGE_COLUMNS)}\n")
    return list(csv.DictReader(io.StringIO(first))), list(csv.DictReader(io.StringIO(",".join(EDGE_COLUMNS) + "\n" + second)))
