"""Operators on the call graph: neighbours, blast radius, paths, rank, cycles.

Nodes are a frame with ``id`` (and whatever else), edges one with ``source, target, kind,
confidence``. Where a walk limits the callers or callees of a node, they are taken by
confidence, then rank, then id, so that results do not depend on the order of rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

CALLS = "calls"
TYPE_KINDS = ("class", "struct", "interface", "trait", "enum", "protocol", "module", "namespace")
#: Edges up to which strongly connected components are found by one task; beyond it, by rounds of joins.
ONE_TASK_EDGES = 500_000


def calls(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind") == CALLS)


def top_neighbours(edges: DataFrame, nodes: DataFrame, of: str, k: int | None) -> DataFrame:
    """Call edges with the neighbour's rank; at most ``k`` for each node of column ``of`` (``target``: its callers).

    The limit is a ranked window, which Spark applies within partitions before it shuffles.
    """
    other = "source" if of == "target" else "target"
    found = calls(edges).join(nodes.select(F.col("id").alias(other), "rank"), other).select(of, other, "confidence", "rank")
    if k is None:
        return found
    order = Window.partitionBy(of).orderBy(F.desc("confidence"), F.desc("rank"), other)
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def callers(edges: DataFrame, nodes: DataFrame, k: int = 20) -> DataFrame:
    """``target, source, confidence, rank, position``: the best ``k`` callers of every node."""
    return top_neighbours(edges, nodes, "target", k)


def callees(edges: DataFrame, nodes: DataFrame, k: int = 20) -> DataFrame:
    return top_neighbours(edges, nodes, "source", k)


def container_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``target, container``: the type-like node that contains each node (the least id, if several do)."""
    types = nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("source"))
    return edges.filter(F.col("kind") == "contains").join(types, "source", "left_semi").groupBy("target").agg(F.min("source").alias("container"))


def base_type_names(refs: DataFrame) -> DataFrame:
    """``source, bases``: names that a type extends or implements."""
    found = refs.filter(F.col("kind").isin("extends", "implements"))
    return found.groupBy(F.col("source_node_id").alias("source")).agg(F.sort_array(F.collect_set("target_name")).alias("bases"))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes``; two semi joins."""
    ends = nodes.select("id").distinct()
    return edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")


def top_subgraph(edges: DataFrame, nodes: DataFrame, limit: int = 150) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` nodes of highest rank with a size for drawing, and the edges among them."""
    top = nodes.filter(F.col("kind") != "file").orderBy(F.desc("rank"), "id").limit(limit)
    return top.withColumn("size", F.round(F.col("rank") * 100) + 1), subgraph(edges, top)


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, nodes: DataFrame | None = None, per_node: int | None = 100, most_seeds: int | None = None) -> DataFrame:
    """``seed, id, depth``: everything that calls a seed, directly or not, within ``max_depth`` calls.

    ``seeds`` has ``id``. All seeds walk at once, as frontiers of (seed, node) pairs; a level
    is one join, and what was visited is kept out by an anti join, so cycles end. Each
    frontier is computed once and kept in the shared folder, so plans stay short. The seed
    itself is not in its result. With ``nodes`` at most ``per_node`` callers of a node are
    followed. With ``most_seeds`` a node is walked on for that many of its nearest seeds
    only; two are enough to know all nodes that reach any other seed.
    """
    step = top_neighbours(edges, nodes, "target", per_node).select("source", "target") if nodes is not None and per_node else calls(edges).select("source", "target").distinct()
    step = cut(step)
    frontier = cut(seeds.select("id").distinct()).select(F.col("id").alias("seed"), "id")
    seen, levels = frontier, []
    for depth in range(1, max_depth + 1):
        reached = frontier.join(step, frontier["id"] == step["target"]).select("seed", F.col("source").alias("id")).distinct()
        reached = reached.join(seen, ["seed", "id"], "left_anti")
        if most_seeds:
            place = F.row_number().over(Window.partitionBy("id").orderBy("seed")) + F.coalesce("n", F.lit(0))
            reached = reached.join(seen.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").withColumn("place", place).filter(F.col("place") <= most_seeds).select("seed", "id")
        frontier = cut(reached)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    if not levels:
        return frontier.withColumn("depth", F.lit(0)).limit(0)
    return functools.reduce(DataFrame.unionByName, levels)


def call_path(edges: DataFrame, source: str, target: str, nodes: DataFrame | None = None, per_node: int = 50, max_visited: int = 10_000, one_task: int = ONE_TASK_EDGES) -> list[str] | None:
    """A shortest chain of calls from ``source`` to ``target`` as ids, or None.

    Each node is reached from its least possible predecessor of the level before, so the
    answer is unique, however long it is. The walk gives up beyond ``max_visited`` nodes.
    A graph whose edges were counted and are few is walked by one task; in a larger one a
    level is a join, levels are kept as (node, parent) tables, and only the answer's nodes
    come to the driver.
    """
    if source == target:
        return [source]
    spark = edges.sparkSession
    step = (top_neighbours(edges, nodes, "source", per_node) if nodes is not None else calls(edges)).select("source", "target").distinct()
    step = cut(step)
    if step.count() <= one_task:

        def run(frames):
            import pandas as pd

            after: dict = {}
            for frame in frames:
                for a, b in zip(frame["source"], frame["target"]):
                    after.setdefault(a, []).append(b)
            parent, frontier = {source: None}, [source]
            while frontier and target not in parent and len(parent) <= max_visited:
                reached: dict = {}
                for a in frontier:
                    for b in after.get(a, ()):
                        if b not in parent and (b not in reached or a < reached[b]):
                            reached[b] = a
                parent |= reached
                frontier = list(reached)
            path = [target] if target in parent else []
            while path and path[-1] != source:
                path.append(parent[path[-1]])
            yield pd.DataFrame({"at": range(len(path)), "id": pd.Series(path[::-1], dtype=object)})

        path = [r["id"] for r in step.coalesce(1).mapInPandas(run, "at int, id string").orderBy("at").collect()]
        return path or None
    seen = spark.createDataFrame([(source,)], "id string")
    frontier, levels, visited = seen, [], 1
    while visited <= max_visited:
        reached = step.join(frontier.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        reached = cut(reached.join(seen, "id", "left_anti"))
        n = reached.count()
        if not n:
            return None
        levels.append(reached)
        if reached.filter(F.col("id") == target).count():
            path = [target]
            for level in reversed(levels):
                path.append(level.filter(F.col("id") == path[-1]).first()["parent"])
            return path[::-1]
        visited += n
        frontier = reached.select("id")
        seen = seen.unionByName(frontier)
        if len(levels) % 16 == 0:  # levels are kept already; this only keeps the plan short
            seen = cut(seen)
    return None


def pagerank(ids: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, cut_every: int = 5, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``id, rank`` with the largest rank 1. Parallel edges count each; edges to unknown ids are left out.

    A graph whose nodes and edges were counted and are few is ranked by one task. For a
    larger one a round is one join on the source and one sum by target, with partial sums
    before the shuffle; the mass of nodes without edges is a one-row frame that is joined
    in, not fetched. Lineage is cut every few rounds through the shared folder.
    """
    nodes = cut(ids.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    known = cut(subgraph(edges.select("source", "target"), nodes))
    if max(n, known.count()) <= one_task:
        both = nodes.select(F.col("id").alias("source"), F.lit(None).cast("string").alias("target")).unionByName(known)

        def run(frames):
            import numpy as np
            import pandas as pd

            every = pd.concat(list(frames))
            names = every.loc[every["target"].isna(), "source"].to_numpy()
            at = pd.Index(names)
            pairs = every[every["target"].notna()]
            a, b = at.get_indexer(pairs["source"]), at.get_indexer(pairs["target"])
            out = np.bincount(a, minlength=n)
            rank = np.full(n, 1.0 / n)
            for _ in range(iterations):
                given = np.bincount(b, rank[a] / out[a], minlength=n)
                rank = (1 - damping) / n + damping * (given + rank[out == 0].sum() / n)
            yield pd.DataFrame({"id": names, "rank": rank / rank.max()})

        return both.coalesce(1).mapInPandas(run, "id string, rank double")
    out = known.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    links = cut(known.join(out, "source").select("source", "target", (F.lit(1.0) / F.col("out")).alias("share")))
    base = cut(nodes.join(out.withColumnRenamed("source", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling")))
    now = base.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    for k in range(1, iterations + 1):
        given = links.join(now.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        lost = now.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        now = base.join(given, "id", "left").crossJoin(F.broadcast(lost))  # one row
        now = now.select("id", "dangling", (F.lit((1 - damping) / n) + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k % cut_every == 0:
            now = cut(now)
    return normalised(now.select("id", "rank"))


def normalised(ranks: DataFrame) -> DataFrame:
    """Ranks divided by the largest."""
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(F.lit(0.0)).alias("rank"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, fan_in, fan_out`` of every node over call edges within the node set."""
    inside = subgraph(calls(edges), nodes)
    ins = inside.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    outs = inside.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    zero = F.lit(0).cast("bigint")
    return nodes.select("id").distinct().join(ins, "id", "left").join(outs, "id", "left").select("id", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def _least_reachable(edges: DataFrame, nodes: DataFrame, own: Column) -> DataFrame:
    """Fixpoint of ``id, colour``: the least label that reaches each node along edges."""
    now = cut(nodes.select("id", own.alias("colour")))
    while True:
        near = edges.join(now.select(F.col("id").alias("source"), "colour"), "source").groupBy(F.col("target").alias("id")).agg(F.min("colour").alias("near"))
        after = cut(now.join(near, "id", "left").select("id", F.least("colour", F.coalesce("near", "colour")).alias("colour"), (F.col("near") < F.col("colour")).alias("moved")))
        now = after.select("id", "colour")
        if not after.filter("moved").limit(1).count():
            return now


def components_by_rounds(edges: DataFrame) -> DataFrame:
    """Strongly connected components by rounds of joins: ``id, component`` for the nodes on cycles (and single nodes reached late).

    Trim nodes without edges in or out until none is left; colour each node by the least id
    that reaches it; of each colour, the nodes that reach its root within the colour are
    one component; take them out and repeat.
    """
    rest = cut(edges.select("source", "target").filter("source <> target").distinct())
    found = None
    while True:
        while True:  # trim
            n = rest.count()
            rest = cut(rest.join(rest.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(rest.select(F.col("source").alias("target")).distinct(), "target", "left_semi"))
            if rest.count() == n:
                break
        if not n:
            return found if found is not None else edges.sparkSession.createDataFrame([], "id string, component string")
        nodes = rest.select(F.col("source").alias("id")).union(rest.select("target")).distinct()
        colour = _least_reachable(rest, nodes, F.col("id"))
        # backward within a colour: start at the root, follow reversed edges of the same colour
        same = rest.join(colour.select(F.col("id").alias("source"), F.col("colour").alias("c1")), "source").join(colour.select(F.col("id").alias("target"), F.col("colour").alias("c2")), "target").filter("c1 = c2").select("source", "target")
        same = cut(same)
        reached = cut(colour.filter("id = colour"))
        frontier = reached.select("id")
        while True:
            back = same.join(frontier.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id")).distinct()
            back = cut(back.join(reached, "id", "left_anti"))
            if not back.limit(1).count():
                break
            frontier = back
            reached = cut(reached.unionByName(back.join(colour, "id")))
        part = cut(reached.select("id", F.col("colour").alias("component")))
        found = part if found is None else cut(found.unionByName(part))
        gone = part.select("id")
        rest = cut(rest.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti"))


def tarjan(pairs: list[tuple]) -> list[list]:
    """Strongly connected components of an edge list, without recursion."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    out: list[list] = []
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    out.append(part)
    return out


def cycles(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``component, id, size``: members of strongly connected components of more than one node; component is the least id.

    A graph whose edges were counted and are few goes to one task; a larger one is worked
    by rounds of joins that hold nothing in one place.
    """
    pairs = calls(edges).select("source", "target").filter("source <> target").distinct()
    if pairs.limit(one_task + 1).count() <= one_task:

        def run(frames):
            import pandas as pd

            every = pd.concat(list(frames) or [pd.DataFrame({"source": [], "target": []})])
            rows = [(min(part), v) for part in tarjan(list(zip(every["source"], every["target"]))) if len(part) > 1 for v in part]
            yield pd.DataFrame({"component": [r[0] for r in rows], "id": [r[1] for r in rows]}, dtype=object)

        members = pairs.coalesce(1).mapInPandas(run, "component string, id string")
    else:
        members = components_by_rounds(pairs.withColumn("kind", F.lit(CALLS))).select("component", "id")
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.join(size, "component")
