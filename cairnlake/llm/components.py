"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.session import cut_lineage


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one top: edges lead down, so a top is then the smallest node of its component."""
    tops = stars.select(F.col("_u").alias("_node"), "_v").unionByName(stars.select(F.col("_v").alias("_node"), "_v"))
    several = tops.groupBy("_node").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("_low <> _high")
    return not several.agg(F.count("*")).first()[0]


def components(edges: DataFrame, left: str, right: str, rounds: int = 50) -> DataFrame:
    """``(_node, _component)`` for every node with an edge; a component is named by its smallest node.

    Each round links the larger neighbours of a node to its smallest one, then its smaller
    neighbours; the tables stay as large as the edges and are cut by reliable checkpoints.
    Minima are combined before they are shuffled, and the joins back are plain equality
    joins, which adaptive execution splits where a node has very many neighbours. It ends
    with the first table in which every edge leads to the top of its component.
    """
    a, b = F.col(left), F.col(right)
    stars = cut_lineage(
        edges.where(a != b).select(F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).distinct()
    )
    for _ in range(rounds):
        if _settled(stars):
            break
        both = stars.unionByName(stars.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        lowest = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
        large = (
            both.join(lowest, "_u")
            .where(F.col("_v") > F.col("_u"))
            .select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        )
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(least, "_u").where(F.col("_v") != F.col("_m")).select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        joined = small.unionByName(least.select("_u", F.col("_m").alias("_v"))).distinct()
        stars = cut_lineage(joined)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = stars.select(F.col("_v").alias("_node")).distinct().select("_node", F.col("_node").alias("_component"))
    return stars.select(F.col("_u").alias("_node"), F.col("_v").alias("_component")).unionByName(tops)
