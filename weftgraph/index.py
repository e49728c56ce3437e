"""The index of a project: building, refreshing and asking it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import analysis, context, graph, resolve, search, tables
from .sources import export, gitlog, scan, store
from .sources.config import Config
from .sources.extract import EDGE, NODE, REF, extract


#: Updated paths up to which just these files are read; beyond it, the project is scanned.
FEW_PATHS = 2_000


class Index:
    """All operators over one project's tables; every question returns frames or small Python values.

    The tables are kept at ``location``, a folder on any of Hadoop's file systems (by
    default one in the project).
    """

    def __init__(self, spark: SparkSession, root: str, location: str | None = None):
        self.spark, self.root = spark, str(Path(root).resolve())
        self.store, self.config = store.Store(spark, self.root, location), Config.load(self.root)

    # building

    def build(self, force: bool = False) -> dict[str, int]:
        """Scans, extracts what is new or changed, prunes what is gone, resolves all references, ranks and embeds."""
        found = graph.cut(scan.scan(self.spark, self.root, self.config))
        known = self.store.read("files") if self.store.version() is not None else None
        changed = tables.changed(found, known) if known is not None and not force else found
        gone = tables.pruned(known, found).select(F.col("path").alias("file_path")) if known is not None else None
        return self._write(graph.cut(changed), gone, full=True)

    sync = build

    def apply_changes(self, updated: DataFrame | None = None, removed: DataFrame | None = None, batch: int | None = None, stream: str = "") -> dict[str, int]:
        """Extracts those of the updated paths whose content is new, drops removed ones, and resolves the references that this concerns.

        Ranks and vectors wait for the next build. A batch of a stream that was applied
        already changes nothing.
        """
        if self.store.committed(batch, stream):
            return {"indexed": 0, "removed": 0} | self.stats()
        told = [r["path"] for r in updated.limit(FEW_PATHS + 1).collect()] if updated is not None else []
        if len(told) > FEW_PATHS:
            found = scan.scan(self.spark, self.root, self.config).join(updated.select("path"), "path", "left_semi")
        else:
            found = scan.scan(self.spark, self.root, self.config, told)
        found = graph.cut(found)
        changed = graph.cut(tables.changed(found, self.files()) if self.store.version() is not None else found)
        gone = removed.select(F.col("path").alias("file_path")) if removed is not None else None
        if changed.isEmpty() and (gone is None or gone.isEmpty()):
            return {"indexed": 0, "removed": 0} | self.stats()
        return self._write(changed, gone, full=False, batch=batch, stream=stream)

    def _write(self, changed: DataFrame, gone: DataFrame | None, full: bool, batch: int | None = None, stream: str = "") -> dict[str, int]:
        rows = graph.cut(extract(changed))
        fresh = {
            "nodes": rows.select(F.explode("nodes").alias("x")).select("x.*").withColumn("rank", F.lit(0.0)),
            "edges": rows.select(F.explode("edges").alias("x")).select("x.*"),
            "refs": rows.select("path", F.posexplode("refs").alias("seq", "x")).select("x.*", "seq"),
        }
        fresh["nodes"] = tables.last_of(fresh["nodes"].withColumn("_at", F.col("start_line")), ["id"], "_at").select(*[f.name for f in NODE.fields], "rank")
        fresh["edges"] = fresh["edges"].dropDuplicates(["source", "target", "kind"]).select(*[f.name for f in EDGE.fields])
        files = changed.select("path", "language", "content_hash", "size").join(rows.select("path", "parse_errors", "parse_missing"), "path", "left")
        files = files.select("path", "language", "content_hash", "size", F.current_timestamp().alias("last_indexed"), F.coalesce("parse_errors", F.lit(0)).alias("parse_errors"), F.coalesce("parse_missing", F.lit(0)).alias("parse_missing"))
        slices = changed.select(F.col("path").alias("file_path")).distinct()
        dropped = slices.unionByName(gone) if gone is not None else slices
        postings = search.postings(fresh["nodes"])
        if self.store.version() is not None:
            old = self.store.read("nodes").join(dropped, "file_path", "left_semi").select("id")
            postings = self.store.read("postings").join(old, "id", "left_anti").unionByName(postings)
            nodes, edges, refs = tables.delete_files(self.store.read("nodes"), self.store.read("edges"), self.store.read("refs").drop("ref_id"), dropped)
            fresh["nodes"], fresh["edges"] = nodes.unionByName(fresh["nodes"]), edges.unionByName(fresh["edges"])
            fresh["refs"] = refs.unionByName(fresh["refs"])
            files = self.store.read("files").join(dropped.withColumnRenamed("file_path", "path"), "path", "left_anti").unionByName(files)
        # A reference is named by its file and its place there; names sort as the files do, and no two are alike.
        all_refs = fresh["refs"].withColumn("ref_id", F.concat("file_path", F.lit("#"), F.lpad(F.col("seq").cast("string"), 10, "0")))
        nodes, edges = graph.cut(fresh["nodes"]), graph.cut(fresh["edges"])
        all_refs = graph.cut(all_refs)
        out = {"files": files, "edges": edges, "refs": all_refs, "postings": search.by_term(postings)}
        if full or not self.store.has("derived"):
            derived = graph.cut(resolve.resolve(all_refs, nodes, edges))
            symbols = nodes.filter("kind <> 'file'")
            ranks = graph.pagerank(symbols.select("id"), graph.calls(derived))
            nodes = nodes.drop("rank").join(ranks, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
            out["embeddings"] = search.by_dim(search.embed_nodes(symbols))
        else:
            derived = graph.cut(resolve.resolve_incrementally(self.store.read("derived"), all_refs, nodes, edges, dropped))
        out |= {"nodes": nodes, "derived": derived}
        self.store.commit(out, batch, stream)
        done = {"indexed": changed.count(), "removed": gone.count() if gone is not None else 0}
        return done | self.stats()

    # tables

    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    def edges(self) -> DataFrame:
        """Containment and derived edges."""
        return self.store.read("edges").unionByName(self.store.read("derived").select("source", "target", "kind", "confidence"))

    def files(self) -> DataFrame:
        return self.store.read("files")

    def postings(self) -> DataFrame:
        return self.store.read("postings")

    def vectors(self) -> DataFrame:
        """Vectors of symbols that still are there, as of the last build."""
        return self.store.read("embeddings").join(self.nodes().select("id"), "id", "left_semi")

    def texts(self) -> DataFrame:
        return scan.scan(self.spark, self.root, self.config).select("path", "text")

    # questions

    def stats(self) -> dict[str, int]:
        row = tables.stats(self.files(), self.nodes(), self.edges()).first()
        return row.asDict()

    def status(self, health: bool = False) -> dict:
        edges = self.edges()
        out = self.stats() | {"languages": {r["language"]: r["n"] for r in tables.count_by(self.nodes().filter("kind <> 'file'"), "language").collect()}, "kinds": {r["kind"]: r["n"] for r in tables.count_by(self.nodes(), "kind").collect()}}
        if health:
            out |= {"refs": self.store.read("refs").count(), "embeddings": self.store.read("embeddings").select("id").distinct().count(), "edge_kinds": {r["kind"]: r["n"] for r in tables.count_by(edges, "kind").collect()}, "parse_issues": [r.asDict() for r in tables.parse_issues(self.files()).limit(20).collect()]}
        return out

    def find(self, name: str) -> DataFrame:
        return tables.lookup(self.nodes(), self.spark.createDataFrame([(name,)], "target_name string"))

    def query(self, text: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return self.nodes().join(search.smart_search(self.nodes(), text, kind, limit, self.postings(), self.vectors()), "id").orderBy("position")

    def full_text(self, text: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return search.full_text(self.nodes(), text, kind, limit, postings=self.postings())

    def explore(self, text: str) -> dict[str, DataFrame]:
        return context.explore(self.edges(), self.nodes(), self.texts(), text, self.postings())

    def context(self, text: str, budget: int = context.BUDGET) -> DataFrame:
        return context.pack(self.edges(), self.nodes(), self.texts(), text, budget, self.postings(), self.vectors())

    def callers(self, name: str, limit: int = 20) -> DataFrame:
        ids = self.find(name).select(F.col("id").alias("target"))
        best = graph.callers(self.edges().join(ids, "target", "left_semi"), self.nodes(), limit)
        return self.nodes().drop("rank").join(best.withColumnRenamed("source", "id"), "id").orderBy("target", "position")

    def callees(self, name: str, limit: int = 20) -> DataFrame:
        ids = self.find(name).select(F.col("id").alias("source"))
        best = graph.callees(self.edges().join(ids, "source", "left_semi"), self.nodes(), limit)
        return self.nodes().drop("rank").join(best.withColumnRenamed("target", "id"), "id").orderBy("source", "position")

    def path(self, source: str, target: str) -> list[str] | None:
        a, b = self.find(source).orderBy("id").first(), self.find(target).orderBy("id").first()
        ids = graph.call_path(self.edges(), a["id"], b["id"], self.nodes()) if a and b else None
        if ids is None:
            return None
        named = {r["id"]: r["qualified_name"] for r in self.nodes().filter(F.col("id").isin(ids)).collect()}
        return [named[i] for i in ids]

    def impact(self, name: str, depth: int = 5) -> DataFrame:
        reached = graph.impact(self.edges(), self.find(name).select("id"), depth, self.nodes()).groupBy("id").agg(F.min("depth").alias("depth"))
        return self.nodes().join(reached, "id").orderBy("depth", "qualified_name")

    def tests(self, name: str, depth: int = 6) -> DataFrame:
        return analysis.related_tests(self.edges(), self.nodes(), self.find(name).select("id"), depth=depth)

    def arch(self) -> dict[str, DataFrame]:
        return analysis.report(self.edges(), self.nodes(), self.root)

    def tree(self, max_depth: int = 3) -> DataFrame:
        """Indexed files up to a depth below the root."""
        rel = F.substring("path", len(self.root) + 2, 1 << 30)
        return self.files().withColumn("relative", rel).filter(paths.depth(F.col("relative")) <= max_depth).orderBy("relative")

    def stale(self) -> DataFrame:
        return tables.stale(self.files(), scan.scan(self.spark, self.root, self.config))

    def cochange(self, least: int = 3, since: str | None = None) -> DataFrame:
        commits = gitlog.parse_log(gitlog.log_frame(self.spark, self.root, since))
        return analysis.co_change(commits, least)

    def diff(self, base: str = "HEAD", depth: int = 2) -> tuple[DataFrame, DataFrame]:
        hunks = gitlog.changed_files(self.spark, self.root, base)
        lines = gitlog.changed_lines(hunks).withColumn("file_path", F.concat(F.lit(self.root + "/"), "file_path"))
        return analysis.diff_impact(self.edges(), self.nodes(), lines, depth)

    def export(self, form: str = "json") -> str:
        return export.render(self.nodes(), self.edges(), form)

    def remove(self) -> bool:
        return self.store.remove()
