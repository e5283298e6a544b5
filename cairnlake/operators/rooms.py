"""Room assignment for files and conversations, and room proposals from folder names."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import lexicons as lex
from cairnlake.functions.params import first_rows
from cairnlake.functions.text import count_occurrences, let, stem

GENERAL = "general"


class Room(NamedTuple):
    """A configured room; the order of a room list is its priority."""

    name: str
    keywords: tuple[str, ...] = ()
    description: str = ""


def _first(options: list[tuple[Column, str]]) -> Column:
    """Name of the first option that holds, NULL when none does."""
    chosen = F.lit(None).cast("string")
    for condition, name in reversed(options):
        chosen = F.when(condition, F.lit(name)).otherwise(chosen)
    return chosen


def _best(scores: list[tuple[Column, str]]) -> Column:
    """Name with the highest positive score, the first of equals."""

    def pick(row: Column) -> Column:
        columns = [row[f"s{i}"] for i in range(len(scores))]
        top = F.greatest(*columns) if len(columns) > 1 else columns[0]
        return F.when(top > 0, _first([(value == top, name) for value, (_, name) in zip(columns, scores)]))

    return let(F.struct(*[score.alias(f"s{i}") for i, (score, _) in enumerate(scores)]), pick)


def _head(content: Column, chars: int | None) -> Column:
    return F.lower(content if chars is None else F.substring(content, 1, chars))


def conversation_room(
    content: Column, topics: dict[str, list[str]] = lex.TOPIC_KEYWORDS, head_chars: int | None = None
) -> Column:
    """Topic with the most keywords present in the text, or in its first ``head_chars`` characters."""

    def score(head: Column) -> Column:
        present = [
            (reduce(lambda a, b: a + b, [F.contains(head, F.lit(word)).cast("int") for word in words]), name)
            for name, words in topics.items()
        ]
        return F.coalesce(_best(present), F.lit(GENERAL))

    return let(_head(content, head_chars), score)


def project_room(path: Column, content: Column, rooms: list[Room], head_chars: int | None = None) -> Column:
    """Room of a project file.

    A folder of the path that contains, or is contained in, a room name or keyword
    decides first; then the file name against the room names; then keyword counts in
    the content, or in its first ``head_chars`` characters.
    """
    if not rooms:
        return F.lit(GENERAL)
    words = {room.name: [word.lower() for word in (*room.keywords, room.name)] for room in rooms}

    def mutual(part: Column, word: str) -> Column:
        return F.contains(part, F.lit(word)) | F.contains(F.lit(word), part)

    def of_folder(part: Column) -> Column:
        return _first(
            [(reduce(lambda a, b: a | b, [mutual(part, word) for word in words[room.name]]), room.name) for room in rooms]
        )

    folders = F.filter(F.slice(F.reverse(F.split(F.lower(path), "/", -1)), 2, 1 << 20), lambda part: part != "")
    by_folder = F.get(
        F.filter(F.transform(F.reverse(folders), of_folder), lambda name: name.isNotNull()), F.lit(0)
    )
    by_name = let(F.lower(stem(path)), lambda name: _first([(mutual(name, room.name.lower()), room.name) for room in rooms]))

    def by_content(head: Column) -> Column:
        return _best(
            [
                (
                    reduce(
                        lambda a, b: a + b,
                        [count_occurrences(head, F.lit(word)) for word in words[room.name] if word.strip()],
                    ),
                    room.name,
                )
                for room in rooms
            ]
        )

    counted = let(_head(content, head_chars), by_content)
    return F.coalesce(by_folder, by_name, counted, F.lit(GENERAL))


def _mapping(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in table.items() for item in pair])


def rooms_from_folders(
    paths: DataFrame, folder_rooms: dict[str, str] = lex.FOLDER_ROOMS, skipped: list[str] = lex.SKIPPED_FOLDERS
) -> DataFrame:
    """Proposed rooms from the first two folder levels of ``path``: ``(room, folder, rank, level)``.

    A first-level folder maps to a known room or, when it starts with a letter and has
    more than two characters, becomes a room itself; a second-level folder only maps.
    Folders are discovered level by level in name order.
    """
    parts = F.split("path", "/", -1)
    folders = paths.select(parts.alias("parts")).select(
        F.explode(
            F.filter(
                F.array(
                    F.when(F.size("parts") >= 2, F.struct(F.lit(1).alias("level"), F.get("parts", F.lit(0)).alias("folder"))),
                    F.when(
                        (F.size("parts") >= 3) & ~F.get("parts", F.lit(0)).isin(skipped),
                        F.struct(F.lit(2).alias("level"), F.get("parts", F.lit(1)).alias("folder")),
                    ),
                ),
                lambda entry: entry.isNotNull(),
            )
        ).alias("entry")
    )
    named = folders.select("entry.level", "entry.folder").distinct().where(~F.col("folder").isin(skipped))
    normal = F.translate(F.lower("folder"), "-", "_")
    mapped = F.try_element_at(_mapping(folder_rooms), normal)
    own = F.when(
        (F.col("level") == 1) & (F.length("folder") > 2) & F.col("folder").rlike(r"^\p{L}"), F.translate(normal, " ", "_")
    )
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, lex.ROOM_ORDER)), F.col("room")), F.lit(0)) - 1, F.lit(2**31 - 1))
    return (
        named.withColumn("room", F.coalesce(mapped, own))
        .where(F.col("room").isNotNull())
        .groupBy("room")
        .agg(F.min(F.struct("level", "folder")).alias("first"))
        .select("room", "first.folder", rank.cast("int").alias("rank"), "first.level")
        .orderBy("rank", "level", "folder")
    )


FILE_NAME_ROOMS = 6


def rooms_from_file_names(
    paths: DataFrame, folder_rooms: dict[str, str] = lex.FOLDER_ROOMS, limit: int | None = FILE_NAME_ROOMS
) -> DataFrame:
    """Rooms whose key words occur in at least two file names, the ``limit`` most frequent.

    A file counts once per matching key word.
    """
    name = F.translate(F.lower(F.substring_index("path", "/", -1)), "- ", "__")
    hits = paths.select(name.alias("name")).select(
        F.explode(F.filter(F.map_entries(_mapping(folder_rooms)), lambda e: F.contains(F.col("name"), e["key"]))).alias("hit")
    )
    counted = hits.groupBy(F.col("hit.value").alias("room")).agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    return first_rows(counted.orderBy(F.desc("n"), "room"), limit)
