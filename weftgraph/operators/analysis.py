"""Reports over the graph: architecture, tests, co-change, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .graph import calls, cycles, degrees, impact, subgraph

#: Files of a commit beyond which it says nothing about coupling.
MAX_COMMIT_FILES = 40
HOTSPOTS, ORPHANS, PAIRS = 15, 50, 100


def hotspots(edges: DataFrame, nodes: DataFrame, limit: int = HOTSPOTS) -> DataFrame:
    return degrees(edges, nodes).filter("fan_in + fan_out > 0").orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(limit)


def orphans(edges: DataFrame, nodes: DataFrame, test: Column | None = None, root: str = "", limit: int = ORPHANS) -> DataFrame:
    """Functions and methods under the root that nothing calls, that are not exported, no tests, and not ``main``."""
    if test is None:
        test = paths.is_test(F.col("kind"), F.col("name"), F.col("file_path"), F.col("qualified_name"))
    called = calls(edges).select(F.col("target").alias("id")).distinct()
    lone = nodes.filter(F.col("kind").isin("function", "method") & ~F.col("is_exported") & ~test & (F.col("name") != "main") & F.startswith("file_path", F.lit(root)))
    return lone.join(called, "id", "left_anti").orderBy("qualified_name", "id").limit(limit)


def layers(nodes: DataFrame, layer: Column) -> DataFrame:
    return nodes.groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("symbols")).orderBy(F.desc("symbols"), "layer")


def coupling(edges: DataFrame, nodes: DataFrame, layer: Column) -> DataFrame:
    """``from_layer, to_layer, n`` of calls between different layers."""
    of = nodes.select("id", layer.alias("layer"))
    found = calls(edges).join(of.select(F.col("id").alias("source"), F.col("layer").alias("from_layer")), "source").join(of.select(F.col("id").alias("target"), F.col("layer").alias("to_layer")), "target")
    return found.filter("from_layer <> to_layer").groupBy("from_layer", "to_layer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_layer", "to_layer")


def layer_cycles(coupled: DataFrame) -> DataFrame:
    """Pairs of layers that call each other."""
    a = coupled.select("from_layer", "to_layer")
    b = coupled.select(F.col("from_layer").alias("to_layer"), F.col("to_layer").alias("from_layer"))
    return a.join(b, ["from_layer", "to_layer"], "left_semi").filter("from_layer < to_layer")


def report(edges: DataFrame, nodes: DataFrame, root: str = "") -> dict[str, DataFrame]:
    """The architecture report as frames."""
    symbols = nodes.filter(F.col("kind") != "file")
    layer = paths.layer(F.col("file_path"), root)
    coupled = coupling(edges, symbols, layer)
    return {"cycles": cycles(subgraph(edges, symbols)), "hotspots": hotspots(edges, symbols), "orphans": orphans(edges, symbols, root=root), "layers": layers(symbols, layer), "coupling": coupled, "layer_cycles": layer_cycles(coupled)}


def related_tests(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, test: Column | None = None, depth: int = 6, per_node: int | None = 200) -> DataFrame:
    """Tests that reach any seed through calls, each once, by qualified name. The walk goes on through tests."""
    if test is None:
        test = paths.is_test(F.col("kind"), F.col("name"), F.col("file_path"), F.col("qualified_name"))
    reached = impact(edges, seeds, depth, nodes, per_node, most_seeds=2).select("id").distinct()
    return nodes.filter(test).join(reached, "id", "left_semi").orderBy("qualified_name", "id")


def changed_symbols(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols whose lines a change touches: ``lines`` has ``file_path, line``. A semi join on the file with a range condition."""
    n, c = nodes.filter(F.col("kind") != "file").alias("n"), lines.alias("c")
    on = (F.col("n.file_path") == F.col("c.file_path")) & F.col("c.line").between(F.col("n.start_line"), F.col("n.end_line"))
    return n.join(c, on, "left_semi")


def diff_impact(edges: DataFrame, nodes: DataFrame, lines: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Changed symbols, and what each of them reaches among callers."""
    touched = changed_symbols(nodes, lines)
    return touched, impact(edges, touched.select("id").distinct(), depth, nodes)


def co_change(commits: DataFrame, least: int = 3, limit: int | None = PAIRS) -> DataFrame:
    """``a, b, together, confidence`` of files that change together: ``commits`` has ``commit, file``.

    Commits of more than 40 files give no pairs (which bounds a key of the self join) but
    count as changes. Confidence is together over the smaller number of changes.
    """
    files = commits.select("commit", "file").distinct()
    changes = files.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    narrow = files.join(files.groupBy("commit").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size").between(2, MAX_COMMIT_FILES)), "commit", "left_semi")
    a, b = narrow.select("commit", F.col("file").alias("a")), narrow.select("commit", F.col("file").alias("b"))
    pairs = a.join(b, "commit").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= least)
    pairs = pairs.join(changes.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(changes.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    pairs = pairs.select("a", "b", "together", (F.col("together") / F.least("na", "nb")).alias("confidence")).orderBy(F.desc("together"), F.desc("confidence"), "a", "b")
    return pairs.limit(limit) if limit is not None else pairs
