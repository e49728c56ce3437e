"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``): root is the component's least node.

    Each round hooks every root that sees a smaller one to the least it sees, follows the
    hooks to their ends by pointer jumping, and leaves only the edges between different
    roots. It ends when there are none. A root that is not hooked and that nothing hooks
    to has only neighbours that found a smaller root, so it is hooked in the next round:
    the roots of a component at least halve in two rounds, whatever its diameter and
    numbers. Sums and minima are taken before rows are shuffled.
    """
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = written(edges.filter("a <> b").select(*ordered).distinct(), "edges")
    now = None
    while now is None or left.limit(1).count():
        hooks = written(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            far = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
            after = written(hooks.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "hooks")
            hooks = after.select("node", "root")
            if not after.filter("moved").limit(1).count():
                break
        if now is None:
            tops = left.select(F.col("a").alias("node")).distinct().join(hooks, "node", "left_anti")
            now = written(hooks.unionByName(tops.select("node", F.col("node").alias("root"))), "roots")
        else:
            now = written(_renamed(now, hooks, "root"), "roots")
        left = written(_renamed(_renamed(left, hooks, "a"), hooks, "b").filter("a <> b").select(*ordered).distinct(), "edges")
    return now


def _renamed(df: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """``df`` with the nodes of a column replaced by what they are hooked to."""
    new = hooks.select(F.col("node").alias(column), F.col("root").alias("hooked_to"))
    return df.join(new, column, "left").withColumn(column, F.coalesce("hooked_to", column)).drop("hooked_to").select(*df.columns)
