"""Partitioning helpers for steps that cost much CPU per byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.session import cut_lineage


SPREAD = "spark.cairnlake.spread"
#: Narrow rows that every task may hold.
FEW_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan over the number of partitions that the session sets in ``spark.cairnlake.spread``.

    Meant for tables of a single small file; without the setting the splits of the reader
    (``spark.sql.files.maxPartitionBytes``) stay as they are.
    """
    parts = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(parts) if parts > 0 else df


def keep_wide(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys``; joins and groupings on the keys reuse the partitioning.

    The number of partitions is left to the session and to adaptive execution.
    """
    return df.repartition(*keys)


def deal_reads(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows that stand for something to be read over ``spark.sql.shuffle.partitions`` tasks.

    Such rows are few bytes each, so adaptive execution would join their partitions into
    one task that reads everything; a number that is given stays.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def broadcast_few(df: DataFrame) -> DataFrame:
    """``df``, kept, with a hint to broadcast it when it is measured to have few rows."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= FEW_ROWS else kept


def explode_rows(df: DataFrame, values: Column, name: str, *kept: str | Column) -> DataFrame:
    """One row per element of ``values`` next to the ``kept`` columns.

    The outer form with a later filter keeps the optimizer from inferring, and pushing
    below, a filter that would evaluate an expensive array a second time.
    """
    return df.select(*kept, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, values: Column, position: str, name: str, *kept: str | Column) -> DataFrame:
    """Like ``explode_rows`` with the position of each element."""
    return df.select(*kept, F.posexplode_outer(values).alias(position, name)).where(F.col(position).isNotNull())
