"""Changes of a drawer table, each as a new DataFrame.

Nothing is updated in place: an operator returns the rows to append or the table
after the change, and ``sources.store`` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.params import DUPLICATE_THRESHOLD
from cairnlake.functions.text import agent_wing, clean_content, content_id, diary_id, display_name, let, slug
from cairnlake.operators.postings import TextIndex, accepted_in_order, best_matches
from cairnlake.session import cut_lineage

#: Matches that a duplicate check reports.
MATCHES = 5


def new_drawers(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose id is not stored yet; one row per id."""
    return incoming.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def delete_ids(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti")


def delete_outcomes(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """``success`` or ``not_found`` for every requested id."""
    present = stored.select("id").distinct().withColumn("found", F.lit(True))
    return ids.join(present, "id", "left").select(
        "id", F.when(F.col("found"), "success").otherwise("not_found").alias("outcome")
    )


def delete_sources(stored: DataFrame, sources: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Table without the drawers of the given ``source_file`` values."""

    def key(column: str) -> Column:
        return F.lower(column) if ignore_case else F.col(column)

    gone = sources.select(key("source_file").alias("_key")).distinct()
    return stored.withColumn("_key", key("source_file")).join(gone, "_key", "left_anti").drop("_key")


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace stored rows with the same id."""
    return delete_ids(stored, incoming).unionByName(incoming, allowMissingColumns=True)


def file_states(stored: DataFrame, files: DataFrame, by_time: bool = True) -> DataFrame:
    """Mark every ``(source_file, embedding_signature, source_mtime)`` as new, stale or current.

    The drawer with the smallest id among those of the same signature stands for a
    file; without a stored time it is stale. ``by_time=False`` looks at the path only.
    """
    known = stored.groupBy(F.lower("source_file").alias("_key"), F.col("embedding_signature").alias("_signature")).agg(
        F.min_by(F.struct("source_mtime"), "id").alias("_first")
    )
    seen = stored.select(F.lower("source_file").alias("_key")).distinct().withColumn("_seen", F.lit(True))
    joined = (
        files.withColumn("_key", F.lower("source_file"))
        .withColumn("_signature", F.col("embedding_signature"))
        .join(known, ["_key", "_signature"], "left")
        .join(seen, "_key", "left")
    )
    same = F.col("_first").isNotNull()
    if by_time:
        same = same & (
            F.col("source_mtime").isNull() | F.coalesce(F.col("_first.source_mtime") == F.col("source_mtime"), F.lit(False))
        )
    state = F.when(same, "current").when(F.col("_seen"), "stale").otherwise("new")
    return joined.select(*files.columns, state.alias("state"))


def repair_order(stored: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same rows, range-partitioned and sorted by id for a clean rewrite."""
    ranged = stored.repartitionByRange(partitions, "id") if partitions else stored.repartitionByRange("id")
    return ranged.sortWithinPartitions("id")


# Fixed limits on the characters of a request's fields.
MOST_CHARS = {"wing": 80, "room": 80, "content": 200_000, "source_file": 1024, "added_by": 160}
REQUIRED = ("wing", "room", "content")


def request_problem() -> Column:
    """Why a ``(wing, room, content, source_file, added_by)`` request is rejected, NULL when it is fine.

    Fields are measured as they would be stored, never cut: a required one may not be
    missing, none may be too long, and a wing or room needs a usable character.
    """

    def check(field: str, most: int) -> Column:
        def judge(value: Column) -> Column:
            checks = [F.when(value == "", F.lit(f"{field} is missing"))] if field in REQUIRED else []
            checks.append(F.when(F.length(value) > most, F.lit(f"{field} has more than {most} characters")))
            if field in ("wing", "room"):
                checks.append(F.when(slug(F.col(field)) == "", F.lit(f"{field} has no usable characters")))
            return F.coalesce(*checks)

        # A text may be long, so it is cleaned once for all of its checks.
        return let(F.coalesce(clean_content(F.col(field)), F.lit("")), judge)

    return F.coalesce(*[check(field, most) for field, most in MOST_CHARS.items()])


def judged_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``status`` (``accepted`` or ``rejected``) and ``reason``."""
    reason = request_problem()
    return requests.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    )


def drawer_requests(requests: DataFrame) -> DataFrame:
    """Cleaned ``(wing, room, content, source_file, added_by)`` requests with their content id."""
    cleaned = requests.select(
        slug(F.col("wing")).alias("wing"),
        slug(F.col("room")).alias("room"),
        clean_content(F.col("content")).alias("text"),
        display_name(F.coalesce("source_file", F.lit(""))).alias("source_file"),
        F.coalesce("added_by", F.lit("tool")).alias("added_by"),
    )
    return cleaned.withColumn("id", content_id(F.col("wing"), F.col("room"), F.col("source_file"), F.col("text")))


def add_outcomes(
    stored: DataFrame,
    requests: DataFrame,
    threshold: float = DUPLICATE_THRESHOLD,
    most: int = MATCHES,
    index: TextIndex | None = None,
) -> DataFrame:
    """What adding each cleaned request does: noop (id exists), duplicate, or inserted.

    Requests are judged in order of ``ord`` where they have it, then of their id, against
    the stored drawers and against those inserted before them. ``matches`` counts the
    drawers that contain enough of the request's tokens, at most ``most`` as the check
    reports them. ``index`` is the stored table's, or made for this call.
    """
    order = F.col("ord").cast("long") if "ord" in requests.columns else F.lit(0).cast("long")
    held = index or TextIndex.of(stored.select("id", "text"))
    # An index made here holds every stored id, so the stored texts are not made again for them.
    present = (held.docs if index is None else stored).select("id").distinct().withColumn("exists", F.lit(True))
    first = requests.groupBy("id").agg(
        F.min(order).alias("ord"), *[F.min_by(name, order).alias(name) for name in ("wing", "room", "text")]
    )
    asked = first.join(present, "id", "left")
    # Only the text of a request that is still open is asked for again.
    asked = cut_lineage(asked.withColumn("text", F.when(F.col("exists").isNull(), F.col("text"))))
    open_requests = asked.where(F.col("exists").isNull())
    queries = open_requests.select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    known = cut_lineage(
        best_matches(queries, held, threshold, most).groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("_stored"))
    )
    judged = open_requests.join(known, "id", "left").select("id", "ord", "text", F.col("_stored").isNotNull().alias("blocked"))
    accepted, met = accepted_in_order(judged, threshold)
    own = met.groupBy("id").agg(F.count("*").alias("_batch"))
    matches = F.coalesce("_stored", F.lit(0)) + F.coalesce("_batch", F.lit(0))
    return (
        asked.join(known, "id", "left")
        .join(own, "id", "left")
        .join(accepted.withColumn("_accepted", F.lit(True)), "id", "left")
        .select(
            "id",
            "wing",
            "room",
            F.when(F.col("exists"), "noop").when(F.col("_accepted"), "inserted").otherwise("duplicate").alias("outcome"),
            F.when(F.col("exists") | F.col("_accepted"), F.lit(0)).otherwise(F.least(matches, F.lit(most))).cast("long").alias("matches"),
        )
    )


def diary_entries(requests: DataFrame, now: str) -> DataFrame:
    """Diary drawers for ``(agent, topic, entry)`` requests written at ``now`` (ISO text)."""
    agent = display_name(F.col("agent"))
    topic = slug(F.coalesce("topic", F.lit("general")))
    entry = clean_content(F.col("entry"))
    wing = agent_wing(agent)
    return requests.select(
        diary_id(wing, topic, entry).alias("id"),
        entry.alias("text"),
        wing.alias("wing"),
        F.lit("diary").alias("room"),
        F.lit("").alias("source_file"),
        F.lit(0).alias("chunk_index"),
        F.lit("tool").alias("added_by"),
        F.lit(now).alias("filed_at"),
        F.lit("hall_diary").alias("hall"),
        topic.alias("topic"),
        F.lit("diary_entry").alias("type"),
        agent.alias("agent"),
        F.lit(now[:10]).alias("date"),
    )


def journal_phase(rows: DataFrame, operation: str, phase: Column, now: str) -> DataFrame:
    """One log line per row of ``(id, wing, room)``; missing columns are logged as NULL."""
    named = [(F.col(c) if c in rows.columns else F.lit(None)).cast("string") for c in ("id", "wing", "room")]
    return rows.select(
        F.lit(now).alias("timestamp"),
        F.lit(operation).alias("operation"),
        phase.alias("phase"),
        *[column.alias(name) for column, name in zip(named, ("drawer_id", "wing", "room"), strict=True)],
    )


def journal_entries(outcomes: DataFrame, operation: str, now: str) -> DataFrame:
    """Append-only log lines of a batch: one intent and one result per request."""
    result = F.when(F.col("outcome") == "inserted", "success").otherwise(F.col("outcome"))
    phases = F.explode(F.array(F.lit("intent"), result)).alias("phase")
    return outcomes.select(
        F.lit(now).alias("timestamp"), F.lit(operation).alias("operation"), phases, F.col("id").alias("drawer_id"), "wing", "room"
    )
