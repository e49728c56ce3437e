"""Extraction queries: every supplier has a source file in each language; the SQL lists what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.extract import extract
from .extract_sources import BROKEN, RECEIVERS, ROUTES, SYMBOLS
from .registry import query

#: Languages of each operator of extraction.
LANGUAGES = {
    "e1_rust": ("rust",),
    "e2_javascript": ("javascript", "typescript"),
    "e3_python": ("python",),
    "e4_go": ("go",),
    "e5_java": ("java",),
    "e6_c_family": ("c", "cpp"),
    "e7_lisps": ("elisp", "commonlisp", "scheme"),
    "e8_ruby": ("ruby",),
    "e9_csharp": ("csharp",),
    "e10_php": ("php",),
    "e11_swift": ("swift",),
    "e12_kotlin": ("kotlin",),
    "e13_dart": ("dart",),
    "e14_components": ("svelte", "vue"),
}


def _sql(sources) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [f"SELECT replace({text(path)}, '§', CAST(s_suppkey AS VARCHAR)) AS path, replace(unnest([{', '.join(map(text, found))}]), '§', CAST(s_suppkey AS VARCHAR)) AS found FROM supplier" for path, _, found in sources.values()]
    return " UNION ALL ".join(parts)


def _extracted(spark, sf, sources):
    """The files of all suppliers, extracted; names have underscores for spaces, and ``name_of`` finds a node's by its id."""
    number = F.col("s_suppkey").cast("string")
    numbered = lambda x: F.replace(F.lit(x), F.lit("§"), number)
    files = F.array(*[F.struct(numbered(path).alias("path"), F.lit(language).alias("language"), numbered(text).alias("text")) for language, (path, text, _) in sources.items()])
    return extract(spark.read.parquet(f"{sf}/supplier.parquet").select(F.explode(files).alias("file")).select("file.*"))


def _name(id_):
    return F.replace(F.filter("nodes", lambda n: n["id"] == id_)[0]["name"], F.lit(" "), F.lit("_"))


def _spelled_refs(kinds=None):
    refs = F.filter("refs", lambda r: r["kind"].isin(*kinds)) if kinds else F.col("refs")
    hint = lambda r: F.coalesce(F.concat(F.lit(" ["), r["receiver_hint"], F.lit("]")), F.lit(""))
    return F.transform(refs, lambda r: F.concat(_name(r["source_node_id"]), F.lit(" -> "), r["kind"], F.lit(" "), r["target_name"], hint(r)))


def _symbols(spark, sf, sources):
    own = lambda n: F.replace(n["name"], F.lit(" "), F.lit("_"))
    nodes = F.transform("nodes", lambda n: F.concat(n["kind"], F.lit(" "), own(n), F.lit(" "), n["start_line"].cast("string"), F.lit("-"), n["end_line"].cast("string")))
    edges = F.transform("edges", lambda e: F.concat(_name(e["source"]), F.lit(" / "), _name(e["target"])))
    return _extracted(spark, sf, sources).select("path", F.explode(F.concat(nodes, edges, _spelled_refs())).alias("found"))


def _register(name: str, sources) -> None:
    def run(spark, sf):
        return _symbols(spark, sf, sources)

    run.__name__ = name
    run.__doc__ = f"Symbols, containment and references of {', '.join(sources)} files."
    query(_sql(sources))(run)


for _query, _languages in LANGUAGES.items():
    _register(_query, {language: SYMBOLS[language] for language in _languages})


@query(_sql({language: (path, text, tuple(f for f in found if " / " in f)) for language, (path, text, found) in SYMBOLS.items()}))
def e15_containment(spark, sf):
    """What contains what, over all languages."""
    return _symbols(spark, sf, SYMBOLS).filter(F.contains("found", F.lit(" / ")))


@query(_sql(RECEIVERS))
def e16_receivers(spark, sf):
    """Calls with what their receivers tell of types."""
    return _extracted(spark, sf, RECEIVERS).select("path", F.explode(_spelled_refs(("calls",))).alias("found"))


@query(_sql(ROUTES))
def e17_routes(spark, sf):
    """Routes with their lines, and references to their handlers."""
    routes = F.transform(F.filter("nodes", lambda n: n["kind"] == "route"), lambda n: F.concat(F.replace(n["name"], F.lit(" "), F.lit("_")), F.lit(" "), n["start_line"].cast("string")))
    return _extracted(spark, sf, ROUTES).select("path", F.explode(F.concat(routes, _spelled_refs(("references",)))).alias("found"))


@query(_sql(BROKEN))
def s14_diagnostics(spark, sf):
    """Errors and missing closings of files that do not parse."""
    told = F.array(F.concat(F.lit("errors "), F.col("parse_errors").cast("string")), F.concat(F.lit("missing "), F.col("parse_missing").cast("string")))
    return _extracted(spark, sf, BROKEN).select("path", F.explode(told).alias("found"))
