"""Queries over the index of a project whose files are written from the nations and regions."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..index import Index
from ..operators.shared import ensure_checkpoint_dir
from ..sources import config, export, gitlog, scan, store
from ..streaming import service
from .projections import frame
from .registry import query

# What the project holds, as the SQL says it as well: a file per nation that calls its region's
# function, a file per region that calls a common one and holds a broken function, and files that
# ignore rules, sizes or the configuration leave out.
_FILES_SQL = r"""files AS (
  SELECT 'src/n' || n_nationkey || '.py' AS path, 'python' AS language, 'from region_' || n_regionkey || ' import serve_' || n_regionkey || chr(10) || chr(10) || 'def open_' || n_nationkey || '():' || chr(10) || '    return serve_' || n_regionkey || '()' || chr(10) AS text FROM nation
  UNION ALL SELECT 'src/region_' || r_regionkey || '.py', 'python', 'def serve_' || r_regionkey || '():' || chr(10) || '    return common()' || chr(10) || chr(10) || 'def broken(:' || chr(10) || '    pass' || chr(10) FROM region
  UNION ALL SELECT 'src/common.py', 'python', 'def common():' || chr(10) || '    return 1' || chr(10)
  UNION ALL SELECT 'notes/n' || n_nationkey || '.go', 'go', 'package n' || n_nationkey || chr(10) FROM nation WHERE NOT starts_with(CAST(n_nationkey AS VARCHAR), '1')
  UNION ALL SELECT '.hidden/r' || r_regionkey || '.rb', 'ruby', 'R' || r_regionkey || ' = 1' || chr(10) FROM region
  UNION ALL SELECT '../more/r' || r_regionkey || '.h', CASE WHEN r_regionkey % 2 = 0 THEN 'cpp' ELSE 'c' END, CASE WHEN r_regionkey % 2 = 0 THEN 'class R {};' ELSE 'int r;' END || chr(10) FROM region)"""


def _folder(spark) -> str:
    """A new folder in the shared one."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = Path(re.sub("^file:/+", "/", shared)) / f"weftgraph-project-{uuid.uuid4().hex}" / "p"
    path.mkdir(parents=True)
    return str(path)


def _write(spark, sf: str) -> str:
    """The project's root, in the shared folder."""
    root = Path(_folder(spark))
    files = {"src/common.py": "def common():\n    return 1\n", "src/wide.py": "x = 1\n" * 2000, "src/old.scm": "(define x 1)\n", ".gitignore": "made/\n", "notes/.gitignore": "n1*.go\n", config.FILE: json.dumps({"max_file_size": 8000, "disabled_languages": ["scheme"], "extra_roots": ["../more", "../none"]})}
    for k, r in spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey").collect():
        files[f"src/n{k}.py"] = f"from region_{r} import serve_{r}\n\ndef open_{k}():\n    return serve_{r}()\n"
        files[f"notes/n{k}.go"] = f"package n{k}\n"
        files[f"made/n{k}.py"] = files[f"target/n{k}.py"] = "def lost():\n    pass\n"
    for (r,) in spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey").collect():
        files[f"src/region_{r}.py"] = f"def serve_{r}():\n    return common()\n\ndef broken(:\n    pass\n"
        files[f".hidden/r{r}.rb"] = f"R{r} = 1\n"
        files[f"../more/r{r}.h"] = "class R {};\n" if r % 2 == 0 else "int r;\n"
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


_built: dict[tuple[str, str], Index] = {}


def _index(spark, sf: str) -> Index:
    """The project's index, built once in an application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _built:
        _built[key] = Index(spark, _write(spark, sf))
        _built[key].build()
    return _built[key]


def _short(index: Index, column):
    """A path or qualified name below the project's root, or beside it."""
    top = str(Path(index.root).parent)
    short = F.regexp_replace(column, f"^{re.escape(index.root)}/", "")
    return F.regexp_replace(short, f"^{re.escape(top)}/", "../")


@query(f"WITH {_FILES_SQL} SELECT path, language, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS content_hash FROM files")
def s1_scan(spark, sf):
    """Files of the project and of its extra root, without those that nested ignore files, sizes or the configuration leave out."""
    index = _index(spark, sf)
    return scan.scan(spark, index.root, index.config).select(_short(index, F.col("path")).alias("path"), "language", "size", "content_hash")


@query(f"WITH {_FILES_SQL} SELECT path, CASE WHEN path LIKE 'src/region%' THEN 1 ELSE 0 END AS parse_errors FROM files")
def k11_diagnostics(spark, sf):
    index = _index(spark, sf)
    return index.files().select(_short(index, F.col("path")).alias("path"), "parse_errors")


_NODES_SQL = r"""nodes AS (
  SELECT 'file' AS kind, path AS qualified_name, CAST(1 AS INT) AS start_line, CAST(len(string_split(rtrim(text, chr(10)), chr(10))) AS INT) AS end_line FROM files
  UNION ALL SELECT 'import', 'src/n' || n_nationkey || '.py::region_' || n_regionkey || '.serve_' || n_regionkey, 1, 1 FROM nation
  UNION ALL SELECT 'function', 'src/n' || n_nationkey || '.py::open_' || n_nationkey, 3, 4 FROM nation
  UNION ALL SELECT 'function', 'src/region_' || r_regionkey || '.py::serve_' || r_regionkey, 1, 2 FROM region
  UNION ALL SELECT 'function', 'src/common.py::common', 1, 2
  UNION ALL SELECT 'class', '../more/r' || r_regionkey || '.h::R', 1, 1 FROM region WHERE r_regionkey % 2 = 0)"""


@query(f"WITH {_FILES_SQL}, {_NODES_SQL} SELECT * FROM nodes")
def k2_nodes(spark, sf):
    index = _index(spark, sf)
    return index.nodes().select("kind", _short(index, F.col("qualified_name")).alias("qualified_name"), "start_line", "end_line")


@query(f"WITH {_FILES_SQL}, {_NODES_SQL} SELECT split_part(qualified_name, '::', 1) AS outer_name, qualified_name AS inner_name FROM nodes WHERE kind <> 'file'")
def k3_contains(spark, sf):
    index = _index(spark, sf)
    name = index.nodes().select("id", _short(index, F.col("qualified_name")).alias("q"))
    edges = index.store.read("edges").filter("kind = 'contains'")
    outer = name.select(F.col("id").alias("source"), F.col("q").alias("outer_name"))
    return edges.join(outer, "source").join(name.select(F.col("id").alias("target"), F.col("q").alias("inner_name")), "target").select("outer_name", "inner_name")


@query("""SELECT 'src/n' || n_nationkey || '.py' AS file_path, 'imports' AS kind, 'region_' || n_regionkey || '.serve_' || n_regionkey AS target_name FROM nation
UNION ALL SELECT 'src/n' || n_nationkey || '.py', 'calls', 'serve_' || n_regionkey FROM nation
UNION ALL SELECT 'src/region_' || r_regionkey || '.py', 'calls', 'common' FROM region""")
def k8_references(spark, sf):
    index = _index(spark, sf)
    return index.store.read("refs").select(_short(index, F.col("file_path")).alias("file_path"), "kind", "target_name")


_CALLS_SQL = """SELECT 'open_' || n_nationkey AS caller, 'serve_' || n_regionkey AS callee, 1.0::DOUBLE AS confidence FROM nation UNION ALL SELECT 'serve_' || r_regionkey, 'common', 1.0 FROM region"""


def _derived(index: Index):
    names = index.nodes().select("id", "name")
    edges = index.store.read("derived").filter("kind = 'calls'")
    return edges.join(names.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("callee")), "target").select("caller", "callee", "confidence")


@query(_CALLS_SQL)
def r2_full_resolve(spark, sf):
    return _derived(_index(spark, sf))


@query(f"""WITH {_FILES_SQL}, {_NODES_SQL} SELECT qualified_name, 1.0::DOUBLE AS norm FROM nodes WHERE kind <> 'file'""")
def k9_embeddings(spark, sf):
    """Every symbol has a vector, of length 1."""
    index = _index(spark, sf)
    norms = index.vectors().groupBy("id").agg(F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"))
    return norms.join(index.nodes(), "id").select(_short(index, F.col("qualified_name")).alias("qualified_name"), "norm")


@query("SELECT 'common' AS name, 1.0::DOUBLE AS rank")
def k10_ranks(spark, sf):
    """What all nations reach ranks highest."""
    return _index(spark, sf).nodes().orderBy(F.desc("rank"), "id").limit(1).select("name", F.round("rank", 6).alias("rank"))


@query("SELECT 'serve_' || r_regionkey AS name FROM region")
def f2_kind_filter(spark, sf):
    """Symbols that a query finds, of one kind only: the files and imports of that name stay out."""
    return _index(spark, sf).full_text("serve", "function", 1000).join(_index(spark, sf).nodes(), "id").filter(F.startswith("name", F.lit("serve"))).select("name")


@query("SELECT 'open_' || n_nationkey AS name, CAST(2 AS INT) AS depth FROM nation UNION ALL SELECT 'serve_' || r_regionkey, 1 FROM region")
def g11_neighbourhood(spark, sf):
    """What reaches the common function, as the pages show it."""
    return _index(spark, sf).impact("common", 3).select("name", "depth")


@query(f"""WITH c AS ({_CALLS_SQL}) SELECT * FROM c WHERE caller NOT IN (SELECT 'open_' || n_nationkey FROM nation WHERE n_regionkey = 1) AND caller <> 'serve_1' AND callee <> 'serve_1'
UNION ALL SELECT 'again_' || n_nationkey, 'common', 1.0 FROM nation WHERE n_regionkey = 1""")
def st3_apply_changes(spark, sf):
    """A region's file is deleted and its nations' files are written again: one incremental change of the index."""
    index = Index(spark, _write(spark, sf))
    index.build()
    src = Path(index.root) / "src"
    (src / "region_1.py").unlink()
    nations = [k for (k,) in spark.read.parquet(f"{sf}/nation.parquet").filter("n_regionkey = 1").select("n_nationkey").collect()]
    for k in nations:
        (src / f"n{k}.py").write_text(f"def again_{k}():\n    return common()\n")
    updated = spark.createDataFrame([(str(src / f"n{k}.py"),) for k in nations], "path string")
    index.apply_changes(updated, spark.createDataFrame([(str(src / "region_1.py"),)], "path string"))
    return _derived(index)


@query(f"""WITH c AS ({_CALLS_SQL}) SELECT * FROM c WHERE caller NOT IN (SELECT 'open_' || n_nationkey FROM nation WHERE n_regionkey IN (2, 3)) AND caller <> 'serve_3' AND callee <> 'serve_3'
UNION ALL SELECT 'late_' || n_nationkey, 'common', 1.0 FROM nation WHERE n_regionkey = 2""")
def st6_sync_and_watch(spark, sf):
    """Files change while nobody watches, and one is deleted; the watcher brings the index up to date before it waits for more."""
    index = Index(spark, _write(spark, sf))
    index.build()
    src = Path(index.root) / "src"
    (src / "region_3.py").unlink()
    for k in [k for (k,) in spark.read.parquet(f"{sf}/nation.parquet").filter("n_regionkey = 2").select("n_nationkey").collect()]:
        (src / f"n{k}.py").write_text(f"def late_{k}():\n    return common()\n")
    service.watch(index, once=True).awaitTermination()
    return _derived(index)


@query("SELECT n_nationkey, n_regionkey FROM nation")
def k12_transaction(spark, sf):
    """What a store holds after a commit that succeeded and one that failed half way."""
    held = store.Store(spark, _folder(spark))
    nation = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey")
    held.commit({"nodes": nation, "files": nation})
    fails = nation.withColumn("n_regionkey", F.when(F.col("n_nationkey") > 20, F.raise_error(F.lit("half way")).cast(nation.schema["n_regionkey"].dataType)).otherwise(F.col("n_regionkey")))
    try:
        held.commit({"files": nation.limit(1), "nodes": fails})
    except PySparkException:
        return held.read("nodes")
    return nation.limit(0)


@query("SELECT x.form, x.known FROM (VALUES ('csv', true), ('dot', true), ('json', true), ('lsif', true), ('xml', false)) x(form, known)")
def k17_export_forms(spark, sf):
    """Forms of export that a graph can be saved in, and one that it cannot."""
    nodes, edges = frame(spark, sf, "part_nodes"), frame(spark, sf, "part_edges")
    rows = []
    for form in ("csv", "dot", "json", "lsif", "xml"):
        try:
            export.save(nodes, edges, f"file://{_folder(spark)}", form)
            rows.append((form, True))
        except ValueError:
            rows.append((form, False))
    return spark.createDataFrame(rows, "form string, known boolean")


@query("SELECT true AS was_there, false AS is_there")
def k19_remove(spark, sf):
    held = store.Store(spark, _folder(spark))
    held.commit({"nodes": spark.read.parquet(f"{sf}/region.parquet")})
    was = held.remove()
    return spark.createDataFrame([(was, held.version() is not None)], "was_there boolean, is_there boolean")


def _repository(spark, sf: str) -> str:
    """A repository with a commit per region, each of the region's file and of a common one."""
    root = _folder(spark)
    git = lambda *a: gitlog.run_git(root, "-c", "user.name=n", "-c", "user.email=n@example.org", *a)
    git("init", "-q")
    for (r,) in spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey").orderBy("r_regionkey").collect():
        (Path(root) / f"region_{r}.py").write_text(f"R = {r}\n")
        (Path(root) / "all.py").write_text(f"FIRST = 0\nLAST = {r}\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"region {r}")
    return root


@query("SELECT 'region_' || r_regionkey || '.py' AS file, 1::BIGINT AS commits FROM region UNION ALL SELECT 'all.py', count(*) FROM region")
def s8_git_log(spark, sf):
    return gitlog.parse_log(gitlog.log_frame(spark, _repository(spark, sf))).groupBy("file").agg(F.countDistinct("commit").alias("commits"))


@query("SELECT 'all.py' AS file_path, CAST(x.line AS INT) AS line FROM (VALUES (2), (3)) x(line)")
def s10_git_diff(spark, sf):
    """Lines that differ from the last commit."""
    root = _repository(spark, sf)
    (Path(root) / "all.py").write_text("FIRST = 0\nMORE = 1\nLAST = -1\n")
    return gitlog.changed_lines(gitlog.changed_files(spark, root)).select("file_path", F.col("line").cast("int").alias("line"))
