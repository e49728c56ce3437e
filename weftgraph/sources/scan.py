"""Scan of source folders as a frame of files."""

from __future__ import annotations

import functools
import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .config import Config

IGNORE_FILES = (".gitignore", ".weftgraphignore")


def global_ignore_file() -> Path | None:
    """The user's own ignore file, as git finds it."""
    try:
        told = subprocess.run(["git", "config", "--global", "--type=path", "core.excludesFile"], capture_output=True, text=True).stdout.strip()
    except OSError:
        told = ""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    path = Path(told) if told else Path(home) / "git" / "ignore"
    return path if path.is_file() else None


def ignore_patterns(root: str, folders: list[str] | None = None) -> list[tuple[str, bool]]:
    """Patterns of the ignore files as (regular expression on paths below the root, is a negation), weakest first.

    The user's own ignore file comes first, then those of the root and of the folders
    below it (``folders``: relative paths, by default all that hold an ignore file), whose
    patterns hold within their folder only.
    """
    if folders is None:
        folders = sorted(os.path.relpath(top, root) for top, names in walk(root) if set(names) & set(IGNORE_FILES))
    out = []
    if own := global_ignore_file():
        out += _patterns(own, "")
    for folder in folders:
        for name in IGNORE_FILES:
            path = Path(root) / folder / name
            if path.is_file():
                out += _patterns(path, "" if folder == "." else folder)
    return out


def _patterns(path: Path, folder: str) -> list[tuple[str, bool]]:
    lines = [line.rstrip() for line in path.read_text(errors="replace").splitlines()]
    lines = [line for line in lines if line and not line.startswith("#")]
    return [(ignore_regex(line.removeprefix("!"), folder), line.startswith("!")) for line in lines]


def walk(root: str) -> Iterator[tuple[str, list[str]]]:
    """Folders below the root, but for those that are always ignored, with their files' names."""
    for top, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in paths.IGNORED)
        yield top, names


def ignore_regex(pattern: str, within: str = "") -> str:
    """An ignore pattern as a regular expression: anchored if it holds an inner slash, of folders only if it ends in one; it holds below ``within``."""
    folder, body = pattern.endswith("/"), pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    marks = {"*": "[^/]*", "?": "[^/]"}
    parts = [".*" if piece == "**" else "".join(marks.get(c, c if c in "[]-" else re.escape(c)) for c in piece) for piece in body.split("/")]
    below = re.escape(within) + "/" if within else ""
    return "^" + below + ("" if anchored else "(.*/)?") + "/".join(parts) + ("/" if folder else "(/|$)")


def hidden_files(root: str) -> list[str]:
    """Files that Spark's listing leaves out: those whose name, or a folder of theirs, starts with a dot or an underscore."""
    found = []
    for top, names in walk(root):
        inside = any(p[:1] in "._" for p in os.path.relpath(top, root).split(os.sep) if p != ".")
        found += [os.path.join(top, n) for n in names if (inside or n[:1] in "._") and n.rpartition(".")[2] in paths.LANGUAGE_OF]
    return sorted(found)


def not_ignored(relative: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Whether the last pattern that matches, if any, is a negation."""
    keep = F.lit(True)
    for regex, negated in patterns:
        keep = F.when(relative.rlike(regex), F.lit(negated)).otherwise(keep)
    return keep


COLUMNS = "path string, language string, size bigint, content_hash string, text string"


def _roots(root: str, config: Config) -> list[str]:
    every = [root, *[str(Path(root) / r) for r in config.extra_roots]]
    return list(dict.fromkeys(str(Path(r).resolve()) for r in every if Path(r).is_dir()))


def _files(spark: SparkSession, folder: str, config: Config, only: list[str] | None = None) -> DataFrame:
    """``path, size, content`` of a folder's files that are not ignored or too large; of ``only`` those paths, if given.

    Columns that a reader does not ask for are not read: a listing without ``content`` opens no file.
    """
    source = lambda: spark.read.format("binaryFile")
    if only is not None:
        files = source().load(only)
    else:
        files = source().option("recursiveFileLookup", "true").load(folder)
        if hidden := hidden_files(folder):
            files = files.unionByName(source().load(hidden))
    full = F.regexp_replace("path", "^[a-z]+:/+", "/")
    files = files.filter(F.col("length") <= config.max_file_size).select(full.alias("path"), F.col("length").alias("size"), "content")
    relative = F.substring("path", len(folder.rstrip("/")) + 2, 1 << 30)
    return files.filter(~paths.ignored(F.col("path")) & not_ignored(relative, ignore_patterns(folder)))


def listing(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """``path`` of every file that :func:`scan` would look at, from the file system's listing alone."""
    config = config or Config.load(root)
    frames = [_files(spark, folder, config).select("path") for folder in _roots(root, config)]
    found = functools.reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "path string")
    return found.filter(paths.language(F.col("path")).isNotNull()).distinct()


def scan(spark: SparkSession, root: str, config: Config | None = None, only: list[str] | None = None) -> DataFrame:
    """``path, language, size, content_hash, text`` of source files under the root and extra roots.

    Hidden files are included; ignored folders, ignore-file matches, unknown or disabled
    languages and files above the size limit are not; extra roots that are missing are
    skipped; a path that two roots share comes once. Sizes are filtered on metadata, so
    large files are never read. ``only`` limits the scan to a few paths; those that are
    gone are left out.
    """
    config = config or Config.load(root)
    frames = []
    for folder in _roots(root, config):
        mine = None if only is None else [p for p in only if p.startswith(folder.rstrip("/") + "/") and os.path.isfile(p)]
        if mine != []:
            frames.append(_files(spark, folder, config, mine))
    if not frames:
        return spark.createDataFrame([], COLUMNS)
    found = functools.reduce(DataFrame.unionByName, frames)
    text = F.expr("cast(content as string)")
    found = found.dropDuplicates(["path"]).withColumn("language", paths.language(F.col("path"))).filter(F.col("language").isNotNull())
    found = found.select("path", "language", "size", F.sha2("content", 256).alias("content_hash"), text.alias("text"))
    found = found.withColumn("language", paths.refined_language(F.col("language"), F.col("path"), F.col("text")))
    return found.filter(~F.col("language").isin(*config.disabled_languages)) if config.disabled_languages else found
