"""Graph of rooms bridged across wings, derived from the drawers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.arrays import last_n
from cairnlake.functions.params import HOPS_LIMIT, clamp_positive, first_rows
from cairnlake.functions.text import is_blank
from cairnlake.session import cut_lineage

# Fixed result caps of the feature.
TRAVERSAL_ROWS = 50
TUNNEL_ROWS = 50
TOP_TUNNELS = 10
SUGGESTIONS = 5
RECENT_DATES = 5


def graph_rows(drawers: DataFrame) -> DataFrame:
    """Rows that can form a node: named wing and room, room not 'general'."""
    return drawers.where(~is_blank(F.col("room")) & (F.col("room") != "general") & ~is_blank(F.col("wing")))


def room_nodes(drawers: DataFrame) -> DataFrame:
    """``(room, wings, halls, n, dates, first_id)`` with sorted distinct arrays, dates cut to the last five.

    ``first_id`` is the smallest drawer id and stands for discovery order. One scan feeds
    a combined count per room, wing, hall and day; a room then holds only its distinct
    names and calendar days.
    """
    combined = (
        graph_rows(drawers)
        .groupBy("room", "wing", "hall", "date")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    )

    def distinct(column: str) -> Column:
        return F.array_sort(F.collect_set(F.when(~is_blank(F.col(column)), F.col(column))))

    return combined.groupBy("room").agg(
        distinct("wing").alias("wings"),
        distinct("hall").alias("halls"),
        F.sum("n").alias("n"),
        last_n(distinct("date"), RECENT_DATES).alias("dates"),
        F.min("first_id").alias("first_id"),
    )


def room_edges(nodes: DataFrame) -> DataFrame:
    """One edge per room, ordered wing pair and hall, weighted with the room's count."""
    wings = nodes.where(F.size("wings") >= 2).select("room", "halls", "n", "wings", F.posexplode("wings").alias("i", "wing_a"))
    pairs = wings.select("room", "halls", "n", "wing_a", F.explode(F.expr("slice(wings, i + 2, size(wings))")).alias("wing_b"))
    return pairs.select("room", "wing_a", "wing_b", F.explode("halls").alias("hall"), "n")


def rooms_per_wing(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("rooms"))


def graph_stats(nodes: DataFrame) -> DataFrame:
    """Rooms, rooms in two or more wings, edges. The edge count follows from the array sizes."""
    wings = F.size("wings").cast("long")
    return nodes.agg(
        F.count("*").alias("total_rooms"),
        F.count_if(wings >= 2).alias("tunnel_rooms"),
        F.coalesce(F.sum(F.expr("bigint(size(wings)) * (size(wings) - 1) div 2 * size(halls)")), F.lit(0)).alias("total_edges"),
    )


def find_tunnels(
    nodes: DataFrame, wing_a: str | None = None, wing_b: str | None = None, limit: int | None = TUNNEL_ROWS
) -> DataFrame:
    """Rooms of two or more wings, the fullest ``limit`` first."""
    tunnels = nodes.where(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        if wing is not None:
            tunnels = tunnels.where(F.array_contains("wings", wing))
    return first_rows(tunnels.orderBy(F.desc("n"), "first_id"), limit).select(
        "room", "wings", "halls", "n", F.coalesce(F.try_element_at("dates", F.lit(-1)), F.lit("")).alias("recent")
    )


def top_tunnels(nodes: DataFrame, limit: int | None = TOP_TUNNELS) -> DataFrame:
    """Rooms of the most wings."""
    shared = nodes.where(F.size("wings") >= 2).orderBy(F.desc(F.size("wings")), "room")
    return first_rows(shared, limit).select("room", "wings", "n")


def suggest_rooms(nodes: DataFrame, query: str, limit: int | None = SUGGESTIONS) -> DataFrame:
    """Rooms whose name contains the query (1.0) or one of its dash-separated words (0.5)."""
    wanted = query.lower()
    name = F.lower("room")
    words = [word for word in wanted.split("-") if word]
    partial = F.lit(False)
    for word in words:
        partial = partial | F.contains(name, F.lit(word))
    score = F.when(F.contains(name, F.lit(wanted)), 1.0).when(partial, 0.5).otherwise(0.0)
    scored = nodes.select("room", score.alias("score")).where(F.col("score") > 0)
    return first_rows(scored.orderBy(F.desc("score"), "room"), limit)


def traverse(
    nodes: DataFrame, start_room: str, max_hops: int | None = None, limit: int | None = TRAVERSAL_ROWS
) -> DataFrame:
    """Breadth-first walk through shared wings: ``(room, wings, halls, n, hop, connected_via)``.

    A room's discovery rank is the path of ``first_id`` values that leads to it, so the
    first discoverer is the minimum rank and no global numbering is needed. Each round
    first reduces the frontier to the best rank per wing, then joins rooms on the wing:
    a wing shared by many rooms costs rows, not pairs of rooms. An unknown start room
    gives an empty result; ``suggest_rooms`` then proposes names.
    """
    hops = clamp_positive(max_hops, HOPS_LIMIT)
    nodes = cut_lineage(nodes)
    room_wings = nodes.select("room", "first_id", F.explode("wings").alias("wing"))
    found = nodes.where(F.col("room") == start_room).select(
        "room",
        F.array("first_id").alias("rank"),
        F.lit(0).alias("hop"),
        F.lit(None).cast("string").alias("parent"),
    )
    frontier = found
    for hop in range(1, hops + 1):
        best = (
            frontier.join(room_wings.select("room", "wing"), "room")
            .groupBy("wing")
            .agg(F.min(F.struct("rank", "room")).alias("via"))
        )
        frontier = cut_lineage(
            room_wings.join(best, "wing")
            .join(found.select("room"), "room", "left_anti")
            .groupBy("room")
            .agg(F.min("via").alias("via"), F.first("first_id").alias("first_id"))
            .select(
                "room",
                F.array_append("via.rank", F.col("first_id")).alias("rank"),
                F.lit(hop).alias("hop"),
                F.col("via.room").alias("parent"),
            )
        )
        found = found.unionByName(frontier)
    parents = nodes.select(F.col("room").alias("parent"), F.col("wings").alias("parent_wings"))
    ordered = found.join(nodes, "room").join(parents, "parent", "left").orderBy("hop", F.desc("n"), "rank")
    return first_rows(ordered, limit).select(
        "room", "wings", "halls", "n", "hop", F.array_sort(F.array_intersect("wings", "parent_wings")).alias("connected_via")
    )
