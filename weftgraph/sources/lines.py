"""Source lines: texts as numbered lines, and slices of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_lines(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """``keys.., line, text``: one row per line, numbered from 1."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "content")).select(*keys, (F.col("pos") + 1).alias("line"), F.col("content").alias("text"))


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, both included) as an array; empty beyond the end of the text."""
    every = F.split(text, "\n")
    every = F.when(F.element_at(every, -1) == "", F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every)
    return F.slice(every, start, F.greatest(F.lit(0), end - start + 1))
