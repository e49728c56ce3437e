"""The shared folder for tables that cut lineage, and size checks before broadcasting."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side, in rows by count, that an operator broadcasts.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's ``spark.checkpoint.dir``.

    Where none is set, a temporary folder of this machine, but only if Spark runs on this
    machine alone; elsewhere executors would not see each other's files, so that raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if counting shows at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``number`` (from 1) in the order of a unique ``key``, and ``before``, the sum of ``weight`` over smaller keys.

    Rows are dealt to sorted ranges of the key; a range is numbered by itself and shifted
    by the counts of the ranges before it, of which there are as many as partitions. So no
    task sees all rows.
    """
    own = F.coalesce(F.col(weight), F.lit(0)).cast("bigint") if weight else F.lit(0).cast("bigint")
    dealt = cut(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()).withColumn("_own", own))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_own").alias("_w"))
    shifts = sums.select("_part", F.coalesce(F.sum("_n").over(order), zero).alias("_n"), F.coalesce(F.sum("_w").over(order), zero).alias("_w"))
    here = Window.partitionBy("_part").orderBy(key)
    out = dealt.join(F.broadcast(shifts), "_part").withColumn("number", F.col("_n") + F.row_number().over(here))
    return out.withColumn("before", F.col("_w") + F.sum("_own").over(here) - F.col("_own")).drop("_part", "_own", "_n", "_w")
