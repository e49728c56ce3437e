"""Explore a query's surroundings, and pack code into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import callees, callers
from .search import full_text, smart_search

# Limits and priorities of exploring and packing.
HITS, NEIGHBOURS, LINES, BLAST = 20, 10, 60, 30
SEEDS, SEED_CALLEES, SEED_CALLERS, PACK_LINES, BUDGET = 16, 8, 4, 40, 8_000
SEED_PRIORITY, CALLEE_PRIORITY, CALLER_PRIORITY = 1000, 500, 300
UNPACKED_KINDS = ("file", "import", "export", "parameter")


def snippets(nodes: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """``id, lines``: up to ``most`` source lines of each node as (line, text); ``files`` has ``path, text``."""
    cut = F.slice(F.split("text", "\n"), F.col("start_line"), F.greatest(F.lit(0), F.least(F.lit(most), F.col("end_line") - F.col("start_line") + 1)))
    have = nodes.join(files.select(F.col("path").alias("file_path"), "text"), "file_path")
    numbered = F.transform(cut, lambda x, i: F.struct((F.col("start_line") + i).alias("line"), x.alias("text")))
    return have.select("id", numbered.alias("lines"))


def explore(edges: DataFrame, nodes: DataFrame, files: DataFrame, query: str, postings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Full-text hits with their best callers, callees and source lines, and the direct callers of all hits."""
    hits = full_text(nodes, query, limit=HITS, postings=postings)
    found = nodes.join(hits, "id")
    who = F.array_sort(F.collect_list(F.struct("position", "other")))
    up = callers(edges.join(found.select(F.col("id").alias("target")), "target", "left_semi"), nodes, NEIGHBOURS).select(F.col("target").alias("id"), F.col("source").alias("other"), "position").groupBy("id").agg(who.alias("callers"))
    down = callees(edges.join(found.select(F.col("id").alias("source")), "source", "left_semi"), nodes, NEIGHBOURS).select(F.col("source").alias("id"), F.col("target").alias("other"), "position").groupBy("id").agg(who.alias("callees"))
    names = lambda c: F.transform(c, lambda x: x["other"])
    symbols = found.join(up, "id", "left").join(down, "id", "left").join(snippets(found, files, LINES), "id", "left")
    symbols = symbols.withColumn("callers", names("callers")).withColumn("callees", names("callees")).orderBy("score", "id")
    blast = found.select("id").join(edges.filter("kind = 'calls'"), F.col("id") == F.col("target")).select(F.col("source").alias("caller")).distinct().orderBy("caller").limit(BLAST)
    return {"symbols": symbols, "blast_radius": blast}


def pack_greedily(items: DataFrame, budget: int, *by: str) -> DataFrame:
    """Items in the order of ``position`` that fit: the first always, later ones if they fit, until the budget is used.

    ``items`` has ``id, position, tokens``, and the columns ``by`` of which each value has a
    budget of its own. The walk is a fold over one sorted array for each, so it is for
    lists of candidates, not for whole corpora.
    """
    entry = F.array_sort(F.collect_list(F.struct("position", "id", F.col("tokens").cast("bigint").alias("tokens"))))
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<position:int,id:string,tokens:bigint>>").alias("taken"))

    def step(state, x):
        fits = (F.size(state["taken"]) == 0) | ((state["used"] < budget) & (state["used"] + x["tokens"] <= budget))
        return F.struct(
            F.when(fits, state["used"] + x["tokens"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["taken"], F.array(F.struct(x["position"].cast("int").alias("position"), x["id"].alias("id"), x["tokens"].alias("tokens"))))).otherwise(state["taken"]).alias("taken"),
        )

    folded = items.groupBy(*by).agg(F.aggregate(entry, empty, step).alias("s"))
    return folded.select(*by, F.explode("s.taken").alias("x")).select("x.id", *by, "x.position", "x.tokens")


def candidates(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id, priority, reason, position``: seeds, their best callees and callers, each node once, best first."""
    s = seeds.select(F.col("id").alias("seed"), (F.col("position") - 1).alias("i"))
    own = s.select(F.col("seed").alias("id"), (SEED_PRIORITY - F.col("i")).alias("priority"), F.lit("matches the query").alias("reason"), "i", F.lit(0).alias("part"), F.lit(0).alias("k"))
    name = nodes.select(F.col("id").alias("seed"), F.col("name").alias("seed_name"))
    down = callees(edges.join(s.select(F.col("seed").alias("source")), "source", "left_semi"), nodes, SEED_CALLEES).join(s, F.col("source") == F.col("seed")).join(name, "seed")
    down = down.select(F.col("target").alias("id"), (CALLEE_PRIORITY - F.col("i")).alias("priority"), F.concat(F.lit("called by "), "seed_name").alias("reason"), "i", F.lit(1).alias("part"), F.col("position").alias("k"))
    up = callers(edges.join(s.select(F.col("seed").alias("target")), "target", "left_semi"), nodes, SEED_CALLERS).join(s, F.col("target") == F.col("seed")).join(name, "seed")
    up = up.select(F.col("source").alias("id"), (CALLER_PRIORITY - F.col("i")).alias("priority"), F.concat(F.lit("calls "), "seed_name").alias("reason"), "i", F.lit(2).alias("part"), F.col("position").alias("k"))
    first = Window.partitionBy("id").orderBy("i", "part", "k")
    every = own.unionByName(down).unionByName(up).withColumn("n", F.row_number().over(first)).filter("n = 1")
    kept = every.join(nodes.filter(~F.col("kind").isin(*UNPACKED_KINDS)).select("id"), "id", "left_semi")
    return kept.select("id", "priority", "reason", F.row_number().over(Window.orderBy(F.desc("priority"), "i", "part", "k", "id")).alias("position"))


def pack(edges: DataFrame, nodes: DataFrame, files: DataFrame, query: str, budget: int = BUDGET, postings: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """A query's code within ``budget`` tokens (a token for every 4 bytes, body and header apart, rounded up)."""
    seeds = smart_search(nodes, query, limit=SEEDS, postings=postings, vectors=vectors).select("id", "position")
    some = candidates(edges, nodes, seeds).join(nodes, "id")
    some = some.join(snippets(some, files, PACK_LINES), "id", "left")
    body = F.array_join(F.transform(F.coalesce("lines", F.array()), lambda x: x["text"]), "\n")
    header = F.concat_ws(" ", F.col("qualified_name"), F.lit("("), F.col("kind"), F.lit(")"), F.concat_ws(":", "file_path", F.col("start_line").cast("string")))
    tokens = F.ceil(F.octet_length(body) / 4) + F.ceil(F.octet_length(header) / 4)
    priced = some.select("id", "position", "reason", "priority", header.alias("header"), body.alias("body"), tokens.alias("tokens"))
    taken = pack_greedily(priced.select("id", "position", "tokens"), budget)
    return taken.join(priced.drop("position", "tokens"), "id").orderBy("position")
