"""Counts by wing and room.

Everything starts from one count per ``(wing, room)``: the text columns are
never read, the shuffle carries pre-aggregated counts, and the coarser
groupings are computed from that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.params import GROUP_LIMIT
from cairnlake.functions.text import is_blank


def room_counts(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("wing", "room").agg(F.count("*").alias("n"))


def _limited(counts: DataFrame, kind: str, limit: int) -> DataFrame:
    """Largest ``limit`` keys; the flag tells whether any were left out."""
    groups = counts.agg(F.count("*").alias("groups")).scalar()
    return (
        counts.orderBy(F.desc("n"), "key")
        .limit(limit)
        .select(F.lit(kind).alias("kind"), "key", "n", (groups > limit).alias("truncated"))
    )


def status(drawers: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Total, per-wing and per-room counts as ``(kind, key, n, truncated)``."""
    counts = room_counts(drawers)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("total").alias("kind"), F.lit("all").alias("key"), "n", F.lit(False).alias("truncated")
    )
    by_wing = counts.groupBy(F.col("wing").alias("key")).agg(F.sum("n").alias("n"))
    by_room = counts.groupBy(F.col("room").alias("key")).agg(F.sum("n").alias("n"))
    return total.unionByName(_limited(by_wing, "wing", limit)).unionByName(_limited(by_room, "room", limit))


def list_wings(drawers: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    counts = drawers.groupBy("wing").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "wing").limit(limit)


def list_rooms(drawers: DataFrame, wing: str | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    scope = drawers if wing is None else drawers.where(F.col("wing") == wing)
    counts = scope.groupBy("room").agg(F.count("*").alias("n"))
    label = F.lit("all" if wing is None else wing).alias("wing")
    return counts.orderBy(F.desc("n"), "room").limit(limit).select(label, "room", "n")


def taxonomy(drawers: DataFrame, wing_limit: int = GROUP_LIMIT, room_limit: int = GROUP_LIMIT) -> DataFrame:
    """Rooms of the largest wings with each wing's total and how many room groups were left out."""
    counts = room_counts(drawers)
    wings = counts.groupBy("wing").agg(F.sum("n").alias("wing_total"), F.count("*").alias("rooms"))
    top = wings.orderBy(F.desc("wing_total"), "wing").limit(wing_limit)
    rank = F.row_number().over(Window.partitionBy("wing").orderBy(F.desc("n"), "room"))
    return (
        counts.join(top, "wing")
        .withColumn("room_rank", rank)
        .where(F.col("room_rank") <= room_limit)
        .select(
            "wing",
            "wing_total",
            "room",
            "n",
            "room_rank",
            F.greatest(F.col("rooms") - room_limit, F.lit(0)).alias("omitted_rooms"),
        )
    )


def status_tree(drawers: DataFrame) -> DataFrame:
    """Every wing and room, wings by name and rooms by size."""
    return room_counts(drawers).orderBy("wing", F.desc("n"), "room")


def migration_summary(drawers: DataFrame) -> DataFrame:
    """Counts with blank names shown as ``?``."""

    def named(column: str) -> F.Column:
        return F.when(is_blank(F.col(column)), "?").otherwise(F.col(column)).alias(column)

    return room_counts(drawers.select(named("wing"), named("room")))
