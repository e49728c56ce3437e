"""Watching a project: its files as a stream, changes applied to the index batch by batch."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..operators import tables
from ..operators.shared import cut
from ..sources import scan

log = logging.getLogger(__name__)


def gone(index) -> DataFrame:
    """Indexed paths that the project has no more, by an anti join with the listing: no file is opened."""
    return tables.pruned(index.files(), scan.listing(index.spark, index.root, index.config)).select("path")


def pending(index) -> tuple[DataFrame, DataFrame]:
    """Paths whose content differs from the index, and indexed paths that are gone."""
    found = scan.scan(index.spark, index.root, index.config)
    known = index.files()
    return tables.changed(found, known).select("path"), tables.pruned(known, found).select("path")


def watch(index, seconds: int = 2, once: bool = False, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a stream over the project's files that brings the index up to date in every batch; an error is logged and the stream goes on.

    What changed before the start is applied first. Then a batch holds the files that are
    new or were written again; files that were deleted, which a file stream does not tell,
    are found by the listing, at every tick of a clock. With a ``checkpoint`` the store
    knows a batch that is delivered again.
    """
    spark = index.spark
    updated, removed = (cut(df) for df in pending(index))
    if not updated.isEmpty() or not removed.isEmpty():
        index.apply_changes(updated, removed)
    files = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("recursiveFileLookup", "true").option("maxFileAge", "36500d").load(index.root)
    changes = files.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"))
    changes = changes.filter(paths.language(F.col("path")).isNotNull() & ~paths.ignored(F.col("path")))
    if not once:
        clock = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
        changes = changes.unionByName(clock.select(F.lit(None).cast("string").alias("path")))

    def each(batch: DataFrame, batch_id: int) -> None:
        try:
            told = cut(batch.filter("path IS NOT NULL").distinct()), cut(gone(index))
            if not told[0].isEmpty() or not told[1].isEmpty():
                index.apply_changes(*told, batch_id if checkpoint else None, checkpoint or "")
        except Exception:
            log.exception("batch %s was not applied", batch_id)

    writer = changes.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": f"{seconds} seconds"})).start()
