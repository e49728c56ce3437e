"""Maintaining the index from a stream of file changes."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths

log = logging.getLogger(__name__)
DEBOUNCE = "2 seconds"


def relevant(path: Column, more: Column | None = None) -> Column:
    """Changes worth a look: of known languages, outside ignored folders."""
    keep = paths.language(path).isNotNull() & ~paths.ignored(path)
    return keep & more if more is not None else keep


def debounced(changes: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """``path, start, end, n``: bursts of changes of a path with no pause of ``gap`` or more. Works on batch and stream."""
    return changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def collapsed(changes: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last change of each path: ``path, op``, with partial maxima before the shuffle."""
    return changes.groupBy("path").agg(F.max_by("op", F.struct(*order)).alias("op"))


def watch_changes(spark: SparkSession, folder: str, schema: str = "path string, op string, ts timestamp") -> DataFrame:
    """A stream of change records that other processes drop as JSON files into a folder."""
    return spark.readStream.schema(schema).json(folder)


def maintain(changes: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``apply(updated, removed, batch_id)`` on each micro-batch with changes.

    The batch is reduced to the last change of each path and split into updated and
    removed paths. An error is logged and the stream goes on. ``apply`` gets the batch's
    number, by which a store can tell a batch that is delivered again.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = collapsed(batch.filter(relevant(F.col("path")))).persist()
        try:
            if not batch.isEmpty():
                apply(batch.filter("op <> 'remove'").select("path").orderBy("path"), batch.filter("op = 'remove'").select("path").orderBy("path"), batch_id)
        except Exception:
            log.exception("batch %s was not applied", batch_id)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def islands(changes: DataFrame, seconds: float = 2.0) -> DataFrame:
    """The bursts of :func:`debounced` by window functions, for batches whose event times lie close: ``path, burst, n, first, last``."""
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    numbered = changes.withColumn("burst", F.sum(F.when(gap.isNull() | (gap >= int(seconds * 1e6)), 1).otherwise(0)).over(w))
    return numbered.groupBy("path", "burst").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
