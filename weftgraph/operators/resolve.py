"""From references by name to edges with confidence: one set-oriented plan."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import ascii_lower
from .graph import base_type_names, container_of
from .shared import cut, small

# Node kinds that an edge kind may lead to (other edge kinds lead anywhere), and the confidence of each tier.
TARGET_KINDS = {
    "calls": ("function", "method"),
    "extends": ("class", "struct", "interface", "trait", "enum", "type_alias"),
    "implements": ("trait", "interface", "protocol"),
    "instantiates": ("class", "struct", "interface", "enum"),
}
OTHER = "other"
#: What a reference and its candidates have in common: a name, and a class of edges.
_KEY = ["name_key", "class"]
#: Candidates of a name up to which its references meet the list of them.
FEW = 64
#: Nodes in a list of :func:`candidates`, pairs that a task makes, references of a name that it holds, and most tasks.
LISTED, WORK, HELD, MOST_TASKS = 256, 8_000_000, 100_000, 20_000
TIERS = {"typed": 0.98, "only": 1.00, "same_type": 0.97, "inherited": 0.85, "same_file": 0.90, "import_one": 0.80, "import_some": 0.60, "any": 0.40}


def type_token(c: Column) -> Column:
    """Last word of a type, cut at ``<``, last ``::`` part."""
    last = F.element_at(F.split(F.trim(c), r"\s+"), -1)
    return F.element_at(F.split(F.split(last, "<")[0], "::"), -1)


def compatible(edge_kind: Column, node_kind: Column) -> Column:
    """Whether an edge kind may lead to a node kind."""
    ok = F.lit(True)
    for kind, allowed in TARGET_KINDS.items():
        ok = F.when(edge_kind == kind, node_kind.isin(*allowed)).otherwise(ok)
    return ok


def candidates(refs: DataFrame, nodes: DataFrame, *extra: str, listed: int = LISTED, work: int = WORK) -> DataFrame:
    """Pairs of references and nodes of that name or qualified name, of a kind that fits: ``refs``' columns, ``candidate``, ``node_kind`` and ``extra`` columns of the nodes.

    ``refs`` has ``ref_id, target_name, kind``. A node stands once under each name and class
    of edges (:func:`_entries`), so that name, qualified name and kind are one equality. There may be far more
    pairs than rows. A name's nodes go in lists of at most ``listed``, and a list meets all references
    before the next one does: neighbouring rows repeat each other, and Parquet keeps them in less than half the
    space. Tasks are dealt by pairs, about ``work`` each, not by the bytes of what they read; a name that has
    more, or too many references to hold, goes to several tasks.
    """
    key = [*_KEY, "share"]
    asking = refs.withColumn("name_key", F.col("target_name")).withColumn("class", edge_class(F.col("kind")))
    asked = cut(asking.filter("name_key IS NOT NULL").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_refs")))
    entries = _entries(nodes.select("id", "kind", "name", "qualified_name", *extra))
    pairs = F.col("n_refs").cast("double") * F.col("n_all")
    counts = entries.join(small(asked), _KEY).groupBy(*_KEY).agg(F.first("n_refs").alias("n_refs"), F.count(F.lit(1)).alias("n_all"))
    counts = cut(counts.select(*_KEY, pairs.alias("pairs"), F.ceil(F.greatest(pairs / work, F.col("n_refs") / HELD)).cast("int").alias("shares")))
    total = counts.agg(F.sum("pairs")).first()[0] or 0
    tasks = max(1, min(max(math.ceil(total / work), refs.sparkSession.sparkContext.defaultParallelism), math.ceil(32 * total / work), MOST_TASKS))
    shares = small(counts.select(*_KEY, "shares"))

    one = F.struct(F.col("kind").alias("node_kind"), F.col("id").alias("candidate"), *extra)
    dealt = entries.join(shares, _KEY).select(*_KEY, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), one.alias("one")).repartition(tasks, *key)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("one.node_kind", "one.candidate"))
    lists = dealt.withColumn("list", F.floor((place - 1) / listed)).groupBy(*key, "list").agg(F.sort_array(F.collect_list("one")).alias("every"))
    asking = asking.join(shares, _KEY).withColumn("share", F.pmod(F.xxhash64("ref_id"), F.col("shares")).cast("int")).drop("shares").repartition(tasks, *key)
    # The left side is the one that a merge join walks through; the references of a name are held.
    met = lists.hint("merge").join(asking, key).select(*refs.columns, F.explode("every").alias("one"))
    return met.select(*refs.columns, "one.candidate", "one.node_kind", *[f"one.{c}" for c in extra])


def import_segments(refs: DataFrame) -> DataFrame:
    """``file_path, segment``: words of each file's imports, ASCII-lowered."""
    return refs.filter(F.col("kind") == "imports").select("file_path", F.explode(F.split(ascii_lower(F.col("target_name")), r"[^\p{L}\p{N}_]+")).alias("segment")).filter("segment <> ''").distinct()


def _entries(nodes: DataFrame) -> DataFrame:
    """A row per node, name it goes by, and class of edges that may lead to it: what a reference's name and class select."""
    classes = F.filter(F.array(F.lit(OTHER), *[F.when(F.col("kind").isin(*allowed), F.lit(kind)) for kind, allowed in TARGET_KINDS.items()]), lambda c: c.isNotNull())
    names = F.filter(F.array_distinct(F.array("name", "qualified_name")), lambda n: n.isNotNull())
    return nodes.withColumn("name_key", F.explode(names)).withColumn("class", F.explode(classes))


def edge_class(kind: Column) -> Column:
    """Edge kinds that may lead to the same node kinds are of one class."""
    return F.when(kind.isin(*TARGET_KINDS), kind).otherwise(F.lit(OTHER))


def resolve(refs: DataFrame, nodes: DataFrame, edges: DataFrame, all_refs: DataFrame | None = None, few: int = FEW, only_to: DataFrame | None = None) -> DataFrame:
    """``source, target, kind, confidence, tier`` of every reference that finds a node.

    ``refs`` has ``ref_id, source_node_id, target_name, kind, file_path, receiver_hint``;
    ``edges`` the contains edges; ``all_refs`` the references that imports and bases are read
    from (``refs`` itself, if not given). With ``only_to`` (``id``) edges to other nodes are
    left out; these still count as candidates. The tier of a reference is the first of these that
    holds: the hinted type (an authoritative hint ``!T`` that matches nothing drops the
    reference), a single candidate, the caller's own type, a base of it, the same file,
    files that the imports name, all. An edge keeps the confidence of its last reference.

    References alike in all that decides (a caller that calls one name often) are one row
    from the start, by partial aggregates. Names are counted first. A reference to a name
    of at most ``few`` candidates meets the list of them in one join and chooses from it; a
    common name never meets all its references (see :func:`_of_common_names`). Edges, of which
    there may be far more than references, are only aggregated where two references can give
    the same one (see :func:`_alone`).
    """
    told = all_refs if all_refs is not None else refs
    containers = container_of(edges, nodes).join(nodes.select(F.col("id").alias("container"), F.col("name").alias("container_name")), "container")
    targets = nodes.select("id", "kind", "name", "qualified_name", "file_path").join(containers.select(F.col("target").alias("id"), F.col("container").alias("c_type"), F.col("container_name").alias("c_name")), "id", "left")
    targets = targets.join(only_to.select("id").distinct().withColumn("wanted", F.lit(True)), "id", "left") if only_to is not None else targets.withColumn("wanted", F.lit(True))
    keys = cut(refs.select(F.col("target_name").alias("name_key"), edge_class(F.col("kind")).alias("class")).distinct())
    entries = _entries(targets).join(small(keys), _KEY, "left_semi")
    entries = entries.select("name_key", "class", F.col("id").alias("candidate"), "wanted", "c_type", "c_name", type_token(F.col("c_name")).alias("c_token"), F.col("file_path").alias("c_file"), ascii_lower(paths.stem(F.col("file_path"))).alias("stem"))
    entries = cut(entries)
    counts = cut(entries.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_all")))

    some = refs.groupBy("source_node_id", "target_name", "kind", "file_path", "receiver_hint").agg(F.max("ref_id").alias("ref_id"))
    some = _alone(some, nodes, keys.select("name_key").distinct())
    some = some.join(containers.select(F.col("target").alias("source_node_id"), F.col("container").alias("s_type"), F.col("container_name").alias("s_name")), "source_node_id", "left")
    hint = F.regexp_replace("receiver_hint", "^!", "")
    want = F.when(hint == "Self", type_token(F.col("s_name"))).otherwise(hint)
    some = some.select("ref_id", "source_node_id", F.col("target_name").alias("name_key"), "kind", edge_class(F.col("kind")).alias("class"), F.col("file_path").alias("c_file"), want.alias("c_token"), F.when(F.col("kind") == "calls", F.col("s_type")).alias("c_type"), F.startswith("receiver_hint", F.lit("!")).alias("authoritative"), "alone")
    some = cut(some.join(small(counts), _KEY))
    # Only bases of types that contain something are asked for.
    of_types = told.join(containers.select(F.col("container").alias("source_node_id")).distinct(), "source_node_id", "left_semi")
    bases = cut(base_type_names(of_types).select(F.col("source").alias("c_type"), "bases"))
    imported = cut(import_segments(told).select(F.col("file_path").alias("c_file"), F.col("segment").alias("stem")))

    found = []
    rare, common = some.filter(F.col("n_all") <= few), some.filter(F.col("n_all") > few)
    if not rare.isEmpty():
        found += _by_need(_of_rare_names(rare, entries.join(counts.filter(F.col("n_all") <= few), _KEY), bases, imported), rare)
    if not common.isEmpty():
        found += _by_need(_of_common_names(common, entries, bases.withColumn("c_name", F.explode("bases")).drop("bases"), imported), common)
    if not found:
        found = _by_need(_of_rare_names(rare, entries.join(counts, _KEY), bases, imported), rare)
    confidence = F.coalesce(*[F.when(F.col("tier") == name, F.lit(x)) for name, x in TIERS.items()])
    last = functools.reduce(DataFrame.unionByName, found)
    return last.select("source", "target", "kind", confidence.alias("confidence"), "tier")


def twin_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``name_key``: those of ``names`` by which some node goes that also goes by another of them."""
    asked = small(cut(names))
    both = nodes.filter("name <> qualified_name").select("name", "qualified_name")
    for by in ("qualified_name", "name"):
        both = both.join(asked.withColumnRenamed("name_key", by), by, "left_semi")
    return cut(both.select(F.explode(F.array("name", "qualified_name")).alias("name_key")).distinct())


def _alone(some: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``some`` with ``alone``: no other reference can give the same edges.

    Others can if they go from the same node by the same kind to the same name, or to another
    name of the same node; and all can if ids of nodes repeat.
    """
    if not nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return some.withColumn("alone", F.lit(False))
    some = some.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("source_node_id", "target_name", "kind")) == 1)
    twins = twin_names(nodes, names)
    if twins.isEmpty():
        return some
    some = some.join(small(twins.select(F.col("name_key").alias("target_name"), F.lit(True).alias("twin"))), "target_name", "left")
    return some.withColumn("alone", F.col("alone") & F.col("twin").isNull()).drop("twin")


def _by_need(found: DataFrame, refs: DataFrame) -> list[DataFrame]:
    """``source, target, kind, tier``: edges of references that are alone as they are, the others by their last reference."""
    plain = ["source", "target", "kind", "tier"]
    parts = [found.filter("alone").select(*plain)]
    if not refs.filter("NOT alone").isEmpty():
        parts.append(found.filter("NOT alone").groupBy("source", "target", "kind").agg(F.max_by("tier", "ref_id").alias("tier")).select(*plain))
    return parts


def _of_rare_names(refs: DataFrame, entries: DataFrame, bases: DataFrame, imported: DataFrame) -> DataFrame:
    """``source, target, kind, ref_id, tier, alone``: each reference with the list of its candidates, chosen from by expressions."""
    lists = entries.groupBy(*_KEY).agg(F.collect_list(F.struct("candidate", "wanted", "c_type", "c_name", "c_token", "c_file", "stem")).alias("every"))
    stems = imported.groupBy("c_file").agg(F.collect_set("stem").alias("stems"))
    met = refs.join(lists, _KEY).join(bases, "c_type", "left").join(stems, "c_file", "left")
    among = lambda test: F.filter("every", test)
    typed = among(lambda x: x["c_token"] == F.col("c_token"))
    same_type = among(lambda x: x["c_type"] == F.col("c_type"))
    inherited = among(lambda x: F.array_contains("bases", x["c_name"]))
    same_file = among(lambda x: x["c_file"] == F.col("c_file"))
    named = among(lambda x: F.array_contains("stems", x["stem"]))
    told = lambda tier, which: F.struct(F.lit(tier).alias("tier"), F.transform(F.filter(which, lambda x: x["wanted"]), lambda x: x["candidate"]).alias("chosen"))
    choice = (
        F.when(F.size(typed) > 0, told("typed", typed))
        .when(F.col("authoritative") & F.col("c_token").isNotNull(), F.lit(None))
        .when(F.col("n_all") == 1, told("only", F.col("every")))
        .when(F.size(same_type) > 0, told("same_type", same_type))
        .when(F.size(inherited) > 0, told("inherited", inherited))
        .when(F.size(same_file) > 0, told("same_file", same_file))
        .when(F.size(named) == 1, told("import_one", named))
        .when((F.size(named) > 1) & (F.size(named) < F.col("n_all")), told("import_some", named))
        .otherwise(told("any", F.col("every")))
    )
    chosen = met.select(F.col("source_node_id").alias("source"), "kind", "ref_id", choice.alias("choice"), "alone")
    return chosen.select("source", F.explode("choice.chosen").alias("target"), "kind", "ref_id", "choice.tier", "alone")


def _of_common_names(some: DataFrame, entries: DataFrame, bases: DataFrame, imported: DataFrame) -> DataFrame:
    """``source, target, kind, ref_id, tier, alone``, without joining references to all candidates of their names.

    Candidates are counted by name and container, file or file stem; a reference's tier is
    read from these counts by equi-joins on such narrow keys, and only the candidates of
    the tier are then joined, on the same keys.
    """
    counts = {"n_typed": "c_token", "n_same_type": "c_type", "n_same_file": "c_file"}
    for name, by in counts.items():
        some = some.join(small(cut(entries.groupBy(*_KEY, by).agg(F.count(F.lit(1)).alias(name)))), [*_KEY, by], "left")
    first = (
        F.when(F.col("n_typed") > 0, "typed")
        .when(F.col("authoritative") & F.col("c_token").isNotNull(), "none")
        .when(F.col("n_all") == 1, "only")
        .when(F.col("n_same_type") > 0, "same_type")
    )
    some = cut(some.withColumn("tier", first).filter("tier IS NULL OR tier <> 'none'").drop("n_typed", "n_same_type", "authoritative"))

    # What needs a list on the reference's side (bases of its type, imports of its file) is asked only where no tier holds yet.
    of_ref = ["source_node_id", "name_key", "kind", "ref_id"]
    open_refs = some.filter("tier IS NULL")
    inherited = open_refs.join(bases, "c_type").join(entries.select(*_KEY, "c_name").distinct(), [*_KEY, "c_name"], "left_semi").select(*of_ref).distinct().withColumn("inherits", F.lit(True))
    stems = entries.groupBy(*_KEY, "stem").agg(F.count(F.lit(1)).alias("n"))
    named = open_refs.filter("n_same_file IS NULL").join(imported, "c_file").join(stems, [*_KEY, "stem"]).groupBy(*of_ref).agg(F.sum("n").alias("n_named"))
    open_refs = open_refs.join(inherited, of_ref, "left").join(named, of_ref, "left")
    then = (
        F.when(F.col("inherits"), "inherited")
        .when(F.col("n_same_file") > 0, "same_file")
        .when(F.col("n_named") == 1, "import_one")
        .when(F.col("n_named") < F.col("n_all"), "import_some")
        .otherwise("any")
    )
    plain = [*of_ref, "class", "c_file", "c_token", "c_type", "tier", "alone"]
    decided = cut(some.filter("tier IS NOT NULL").select(*plain).unionByName(open_refs.withColumn("tier", then).select(*plain)))

    of = lambda *tiers: decided.filter(F.col("tier").isin(*tiers))
    wanted = entries.filter("wanted")
    on = lambda refs, *by: refs.join(wanted.select(*_KEY, *by, "candidate"), [*_KEY, *by])
    joined = [
        on(of("typed"), "c_token"),
        on(of("only", "any")),
        on(of("same_type"), "c_type"),
        on(of("inherited").join(bases, "c_type"), "c_name"),
        on(of("same_file"), "c_file"),
        on(of("import_one", "import_some").join(imported, "c_file"), "stem"),
    ]
    return functools.reduce(DataFrame.unionByName, [df.select(F.col("source_node_id").alias("source"), F.col("candidate").alias("target"), "kind", "ref_id", "tier", "alone") for df in joined])


def affected_refs(refs: DataFrame, nodes: DataFrame, changed_files: DataFrame) -> DataFrame:
    """References to resolve anew after files changed: those in the files, and those anywhere to names now defined there.

    ``changed_files`` has ``file_path``. A reference of either kind comes once, those in changed files first.
    """
    here = nodes.join(changed_files, "file_path", "left_semi").filter(~F.col("kind").isin("file", "import"))
    names = here.select(F.col("name").alias("target_name")).union(here.select("qualified_name")).distinct()
    names = small(cut(names.join(small(cut(refs.select("target_name").distinct())), "target_name", "left_semi"))).withColumn("now", F.lit(1))
    own = small(changed_files.select("file_path").distinct()).withColumn("first", F.lit(0))
    either = refs.join(own, "file_path", "left").join(names, "target_name", "left").withColumn("first", F.coalesce("first", "now")).drop("now").filter("first IS NOT NULL")
    order = Window.partitionBy("source_node_id", "target_name", "kind").orderBy("first", "ref_id")
    return either.withColumn("n", F.row_number().over(order)).filter("n = 1").select(*refs.columns)


def _redone(again: DataFrame) -> DataFrame:
    return again.select(F.col("source_node_id").alias("source"), "target_name", "kind").distinct()


def _without_stale(kept: DataFrame, redone: DataFrame, nodes: DataFrame) -> DataFrame:
    """``kept`` without edges to nodes by whose names ``redone`` asks. Edges look for their own names; names never meet all their nodes."""
    named = nodes.select(F.col("id").alias("target"), F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("target_name"))
    stale = kept.select("source", "target", "kind").join(named, "target").join(redone, ["source", "target_name", "kind"], "left_semi").select("source", "target", "kind").distinct()
    return kept.join(stale, ["source", "target", "kind"], "left_anti")


def resolve_incrementally(before: DataFrame, refs: DataFrame, nodes: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Derived edges after ``changed_files`` changed: those of affected references anew, the others as they were.

    Edges from or to nodes that are gone or stand in a changed file are left out first.
    """
    again = affected_refs(refs, nodes, changed_files)
    live = nodes.join(changed_files, "file_path", "left_anti").select("id")
    kept = before.join(live.withColumnRenamed("id", "source"), "source", "left_semi").join(live.withColumnRenamed("id", "target"), "target", "left_semi")
    return _without_stale(kept, _redone(again), nodes).unionByName(resolve(again, nodes, edges, refs))


def resolve_changed(refs: DataFrame, old: DataFrame, nodes: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """:func:`resolve_incrementally` where the edges before are those that ``refs`` have by ``old``.

    What is left out of them is known by their references and targets, so it is never made:
    only references that stay are resolved by ``old``. The nodes of files that did not change
    are alike in ``old`` and ``nodes``.
    """
    refs, changed_files = cut(refs), cut(changed_files)
    again = cut(affected_refs(refs, nodes, changed_files))
    redone = _redone(again)
    live = nodes.join(changed_files, "file_path", "left_anti").select("id")
    stay = refs.join(live.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi")
    stay = cut(stay.join(redone.withColumnRenamed("source", "source_node_id"), ["source_node_id", "target_name", "kind"], "left_anti"))
    anew = resolve(again, nodes, edges, refs)
    if stay.isEmpty():
        return anew
    kept = resolve(stay, old, edges, refs, only_to=live)
    if not twin_names(nodes, refs.select(F.col("target_name").alias("name_key")).distinct()).isEmpty():
        kept = _without_stale(kept, redone, nodes)
    return kept.unionByName(anew)
