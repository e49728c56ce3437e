"""Commit logs and diffs: reading them from git, and parsing them as frames."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def run_git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.strip()}")
    return done.stdout


#: Commits of a log that are parsed together.
LOG_COMMITS = 1_000


def log_frame(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Lines of ``git log``: ``log, line_no, text``; a long log is dealt out as logs of ``LOG_COMMITS`` commits."""
    text = run_git(root, "log", "--no-merges", "--pretty=format:@%H", "--name-only", *([f"{since}..HEAD"] if since else []))
    rows, commits = [], 0
    for k, line in enumerate(text.splitlines()):
        commits += line.startswith("@")
        rows.append((max(0, commits - 1) // LOG_COMMITS, k, line))
    return spark.createDataFrame(rows, "log bigint, line_no bigint, text string")


def parse_log(lines: DataFrame) -> DataFrame:
    """``log, commit_no, commit, file``: a line ``@hash`` opens a commit, other lines that are not blank are its files.

    The number of a commit is a running count within its log, so many logs are worked at once.
    """
    w = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.startswith("text", F.lit("@"))
    numbered = lines.withColumn("commit_no", F.sum(head.cast("int")).over(w)).withColumn("commit", F.last(F.when(head, F.substring("text", 2, 1 << 30)), True).over(w))
    return numbered.filter(~head & (F.trim("text") != "") & F.col("commit").isNotNull()).select("log", "commit_no", "commit", F.trim("text").alias("file"))


def changed_files(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """Hunk headers of a diff: ``file_path, header``."""
    rows = []
    for path in run_git(root, "diff", "--name-only", base).splitlines():
        if path:
            rows += [(path, line) for line in run_git(root, "diff", "-U0", base, "--", path).splitlines() if line.startswith("@@")]
    return spark.createDataFrame(rows, "file_path string, header string")


def new_lines(header: Column) -> Column:
    """Line numbers on the new side of a hunk header ``@@ -a,b +c,d @@``; a missing or zero count is one line."""
    start = F.regexp_extract(header, r"\+(\d+)", 1)
    count = F.regexp_extract(header, r"\+\d+,(\d+)", 1)
    first = F.try_to_number(start, F.lit("999999999")).cast("int")
    many = F.when(count == "", 1).otherwise(F.greatest(F.lit(1), F.try_to_number(count, F.lit("999999999")).cast("int")))
    return F.when(first.isNotNull(), F.sequence(first, first + many - 1))


def changed_lines(hunks: DataFrame) -> DataFrame:
    """``file_path, line`` of all hunks."""
    return hunks.select("file_path", F.explode(new_lines(F.col("header"))).alias("line")).distinct()
