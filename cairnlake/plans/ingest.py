"""Ingestion plans: from file rows to new drawers in one job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairnlake.functions.text import mined_id, trim
from cairnlake.operators import chunking, extraction, mutations, rooms, transcripts

# Changes whenever the embedder changes, so that older drawers count as stale.
EMBEDDING_SIGNATURE = "hashed-tokens/384/v1"
MIN_PROJECT_CHARS = 50
MIN_TRANSCRIPT_CHARS = 30


def pending_files(stored: DataFrame, files: DataFrame, by_time: bool = True, signature: str = EMBEDDING_SIGNATURE) -> DataFrame:
    """Files that are new or stale, with their ``state``; current ones are left out before any text is touched."""
    marked = mutations.file_states(stored, files.withColumn("embedding_signature", F.lit(signature)), by_time)
    return marked.where(F.col("state") != "current")


def _drawers(chunks: DataFrame, wing: str, agent: str, now: str, **extra: Column) -> DataFrame:
    return chunks.select(
        mined_id(F.lit(wing), F.col("room"), F.col("source_file"), F.col("chunk_index")).alias("id"),
        F.col("content").alias("text"),
        F.lit(wing).alias("wing"),
        "room",
        "source_file",
        F.col("source_mtime") if "source_mtime" in chunks.columns else F.lit(None).cast("long").alias("source_mtime"),
        "chunk_index",
        F.lit(agent).alias("added_by"),
        F.lit(now).alias("filed_at"),
        F.lit(EMBEDDING_SIGNATURE).alias("embedding_signature"),
        *[value.alias(name) for name, value in extra.items()],
    )


def project_drawers(files: DataFrame, wing: str, room_list: list[rooms.Room], agent: str, now: str) -> DataFrame:
    """Drawers of project files ``(path, source_file, source_mtime, content)``.

    Files shorter than the minimum yield nothing. The room is decided from the whole
    file, then the text is chunked; rows never leave their task.
    """
    trimmed = files.withColumn("content", trim(F.col("content"))).where(F.length("content") >= MIN_PROJECT_CHARS)
    placed = trimmed.withColumn("room", rooms.project_room(F.col("path"), F.col("content"), room_list))
    chunks = chunking.chunk_text(placed.select("source_file", "source_mtime", "room", "content"), "content")
    return _drawers(chunks, wing, agent, now)


def conversation_drawers(
    files: DataFrame,
    wing: str,
    agent: str,
    now: str,
    extract_mode: str = "exchange",
    known_names: Iterable[str] = (),
    topics: dict[str, list[str]] | None = None,
    markers: dict[str, list[str]] | None = None,
    positive: list[str] | None = None,
    negative: list[str] | None = None,
) -> DataFrame:
    """Drawers of transcripts ``(path, source_file, content)`` by exchange, or by memory in ``general`` mode."""
    normal = transcripts.normalize(files, known_names).select("source_file", "transcript")
    usable = normal.where(F.length(trim(F.col("transcript"))) >= MIN_TRANSCRIPT_CHARS)
    if extract_mode == "general":
        lists = {"markers": markers, "positive": positive, "negative": negative}
        options = {name: value for name, value in lists.items() if value is not None}
        chunks = extraction.extract_memories(usable, "transcript", **options).withColumnRenamed("memory_type", "room")
    else:
        options = {} if topics is None else {"topics": topics}
        placed = usable.withColumn("room", rooms.conversation_room(F.col("transcript"), **options))
        chunks = chunking.explode_chunks(placed, chunking.exchange_chunks(F.col("transcript"))).drop("transcript")
    return _drawers(chunks, wing, agent, now, ingest_mode=F.lit("convos"), extract_mode=F.lit(extract_mode))


def refreshed(stored: DataFrame, stale: DataFrame, drawers: DataFrame) -> DataFrame:
    """The table after a run: drawers of pending files removed, new ones added."""
    remaining = mutations.delete_sources(stored, stale.select("source_file"))
    return remaining.unionByName(mutations.new_drawers(remaining, drawers), allowMissingColumns=True)


def room_totals(drawers: DataFrame, per_file: bool = True) -> DataFrame:
    """Files per room, or memories per room when ``per_file`` is off."""
    counted = F.count_distinct("source_file") if per_file else F.count("*")
    return drawers.groupBy("room").agg(counted.alias("n"), F.count("*").alias("drawers"))


def run_totals(files: DataFrame, drawers: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Files read, processed and skipped, and drawers made; with ``rejected`` files, their number as well."""
    made = drawers.groupBy("source_file").agg(F.count("*").alias("made"))
    totals = files.select("source_file").join(made, "source_file", "left").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("made").isNotNull()).alias("processed"),
        F.count_if(F.col("made").isNull()).alias("skipped"),
        F.coalesce(F.sum("made"), F.lit(0)).alias("drawers"),
    )
    return totals if rejected is None else totals.withColumn("rejected", rejected.agg(F.count("*")).scalar())


class RunCounts:
    """Totals of a mining run, observed while its first action runs; no text is read a second time.

    Put ``files`` around the rows to mine and ``drawers`` around what mining makes of them,
    then write. A file counts as processed by its first chunk. Rows of a stage that is
    repeated after a lost executor may be counted twice, so these numbers report progress;
    ``run_totals`` counts exactly.
    """

    def __init__(self) -> None:
        self._files, self._drawers = Observation(), Observation()

    def files(self, files: DataFrame) -> DataFrame:
        return files.observe(self._files, F.count("*").alias("files"))

    def drawers(self, drawers: DataFrame) -> DataFrame:
        first = F.count_if(F.col("chunk_index") == 0)
        return drawers.observe(self._drawers, F.count("*").alias("drawers"), first.alias("processed"))

    def totals(self) -> dict[str, int]:
        """Files, processed, skipped and drawers; waits until both observed frames have run."""
        files, made = self._files.get["files"], self._drawers.get
        return {
            "files": files,
            "processed": made["processed"],
            "skipped": files - made["processed"],
            "drawers": made["drawers"],
        }
