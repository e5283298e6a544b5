"""Ordered computations inside groups that may be very large.

A window over a group puts the whole group into one task. Here a group is cut into
blocks of its order column; a window runs inside each block, and only one summary row
per block goes through a second window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``order``; ``block`` must grow with the order."""
    marked = df.withColumn("_block", block).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    return (
        marked.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_block", "_value", "_inside", "_offset")
    )


def next_value(df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, name: str) -> DataFrame:
    """Value of the following row per ``keys`` in ``order``, NULL at the end of the group."""
    marked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    after = Window.partitionBy(*keys).orderBy("_block")
    heads = (
        marked.groupBy(*keys, "_block")
        .agg(F.min_by(value, F.struct(*order)).alias("_head"))
        .withColumn("_block_next", F.lead("_head").over(after))
        .drop("_head")
    )
    last = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*[F.desc(c) for c in order])) == 1
    return (
        marked.withColumn("_next", F.lead(value).over(inside))
        .withColumn("_last", last)
        .join(heads, [*keys, "_block"])
        .withColumn(name, F.when(F.col("_last"), F.col("_block_next")).otherwise(F.col("_next")))
        .drop("_block", "_next", "_last", "_block_next")
    )
