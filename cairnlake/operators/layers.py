"""Wake-up digests: essential story, recall, diary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.params import DIARY_LIMIT, clamp_positive, first_rows
from cairnlake.functions.text import agent_wing, basename, ellipsis, one_line, trim
from cairnlake.operators.search import get_drawers

# Fixed sizes.
STORY_DRAWERS = 15
STORY_CHARS = 3200
DEFAULT_IMPORTANCE = 3.0
IDENTITY_DEFAULT = "## L0 - IDENTITY\nNo identity configured."


def identity(text: str | None) -> str:
    """Configured identity text, or the default line."""
    return text.strip() if text is not None else IDENTITY_DEFAULT


def story_rows(drawers: DataFrame, wing: str | None = None, limit: int | None = STORY_DRAWERS) -> DataFrame:
    """The ``limit`` most important drawers, as bullet lines ordered by room and importance."""
    score = F.coalesce("importance", "emotional_weight", "weight", F.lit(DEFAULT_IMPORTANCE))
    scored = get_drawers(drawers, wing).select("id", "room", "source_file", "text", score.alias("score"))
    top = first_rows(scored.orderBy(F.desc("score"), "id"), limit)
    source = basename(F.col("source_file"))
    line = F.concat(
        F.lit("  - "),
        ellipsis(one_line(F.col("text")), 200, 197),
        F.when(trim(source) != "", F.concat(F.lit("  ("), source, F.lit(")"))).otherwise(""),
    )
    return top.select("id", "room", "score", line.alias("line"))


def story_budget(rows: DataFrame, chars: int = STORY_CHARS) -> DataFrame:
    """Rows that fit the budget of ``chars``; room headings count. Only the few rows of a digest come in."""
    order = [F.asc("room"), F.desc("score"), F.asc("id")]
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.row_number().over(Window.partitionBy("room").orderBy(*order[1:])) == 1
    size = F.length("line") + F.when(F.col("opens"), F.length("room") + 3).otherwise(0)
    return (
        rows.withColumn("opens", opens)
        .withColumn("used", F.sum(size).over(so_far))
        .withColumn("place", F.row_number().over(Window.orderBy(*order)))
        .withColumn("fits", F.col("used") <= chars)
    )


def render_story(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    """The digest as one text row; a cut list ends with a pointer to search.

    When the first line of a room overflows, the room heading stays and the pointer follows.
    """
    placed = story_budget(story_rows(drawers, wing))
    kept = placed.withColumn(
        "first_over", F.min(F.when(~F.col("fits"), F.col("place"))).over(Window.partitionBy(F.lit(1)))
    ).where(F.col("first_over").isNull() | (F.col("place") <= F.col("first_over")))
    heading = F.when(F.col("opens"), F.concat(F.lit("\n["), F.col("room"), F.lit("]\n"))).otherwise("")
    body = F.concat(heading, F.when(F.col("fits"), F.col("line")).otherwise("  ... (more in L3 search)"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", body.alias("body")))), lambda e: e["body"])
    return kept.agg(lines.alias("lines")).select(
        F.when(F.size("lines") == 0, "## L1 - No memories yet.")
        .otherwise(F.concat(F.lit("## L1 - ESSENTIAL STORY\n"), F.array_join("lines", "\n")))
        .alias("rendered")
    )


def recall(drawers: DataFrame, wing: str | None = None, room: str | None = None, limit: int = 10) -> DataFrame:
    """First drawers in store order with their total count and one-line snippets."""
    scope = get_drawers(drawers, wing, room)
    total = scope.agg(F.count("*")).scalar()
    source = basename(F.col("source_file"))
    entry = F.concat(
        F.lit("  ["),
        F.col("room"),
        F.lit("] "),
        ellipsis(one_line(F.col("text")), 300, 297),
        F.when(trim(source) != "", F.concat(F.lit("  ("), source, F.lit(")"))).otherwise(""),
    )
    return scope.orderBy("id").limit(limit).select("id", entry.alias("entry"), total.alias("total"))


def diary_read(drawers: DataFrame, agent: str, last_n: int | None = None) -> DataFrame:
    """Newest diary entries of an agent with the total number of entries."""
    entries = drawers.where((F.col("wing") == agent_wing(F.lit(agent))) & (F.col("room") == "diary"))
    total = entries.agg(F.count("*")).scalar()
    return (
        entries.orderBy(F.desc("filed_at"), "id")
        .limit(clamp_positive(last_n, DIARY_LIMIT))
        .select(
            "id",
            F.coalesce("date", F.lit("")).alias("date"),
            F.col("filed_at").alias("timestamp"),
            F.coalesce("topic", F.lit("")).alias("topic"),
            F.col("text").alias("content"),
            total.alias("total"),
        )
    )


def stack_status(drawers: DataFrame) -> DataFrame:
    return drawers.agg(F.count("*").alias("total_drawers")).select(
        "total_drawers", F.lit(STORY_DRAWERS).alias("story_drawers"), F.lit(STORY_CHARS).alias("story_chars")
    )
