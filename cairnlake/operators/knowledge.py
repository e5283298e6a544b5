"""Temporal knowledge graph: entity, relationship and timeline queries, fact changes.

Facts are ``triples`` keyed by normalised entity ids with closed ISO-text
validity intervals; a NULL end is open. ``entities`` gives the display names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.params import first_rows
from cairnlake.functions.text import entity_id, predicate_id

TIMELINE_ROWS = 100
#: Subjects of more facts are cut in time by ``as_of_batch``, and the facts of a span into pieces.
HOT_FACTS, PIECES = 10_000, 64
#: Months of four-digit years, and the sizes of spans over them: 1, 2, 4, ... months.
MONTHS = 12 * 10_000
MONTH_LEVELS, LEVEL_PLACES = MONTHS.bit_length(), 1 << MONTHS.bit_length()


def valid_on(day: Column) -> Column:
    """Interval containment on text dates, both ends included."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (
        F.col("valid_to").isNull() | (F.col("valid_to") >= day)
    )


def is_current() -> Column:
    return F.col("valid_to").isNull()


def _as_of(facts: DataFrame, as_of: str | None) -> DataFrame:
    return facts if not as_of else facts.where(valid_on(F.lit(as_of)))


FACT = ["predicate", "valid_from", "valid_to", "confidence"]


def query_entity(
    triples: DataFrame, entities: DataFrame, entity: str, as_of: str | None = None, direction: str = "outgoing"
) -> DataFrame:
    """Facts around one entity; the asked side echoes the caller's spelling.

    An unknown direction yields no rows; a self-loop shows up once per direction.
    """
    wanted = entity_id(F.lit(entity))
    names = entities.select(F.col("id").alias("other"), F.col("name").alias("other_name"))

    def side(own: str, other: str, label: str) -> DataFrame:
        facts = _as_of(triples.where(F.col(own) == wanted), as_of).withColumn("other", F.col(other))
        shown = facts.join(names, "other")
        subject, obj = ("asked", "other_name") if label == "outgoing" else ("other_name", "asked")
        return shown.withColumn("asked", F.lit(entity)).select(
            F.lit(label).alias("direction"),
            F.col(subject).alias("subject"),
            F.col(obj).alias("object"),
            *FACT,
            is_current().alias("current"),
        )

    outgoing = side("subject", "object", "outgoing")
    incoming = side("object", "subject", "incoming")
    if direction == "outgoing":
        return outgoing
    if direction == "incoming":
        return incoming
    if direction == "both":
        return outgoing.unionByName(incoming)
    return outgoing.where(F.lit(False))


def _named(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with the names of both ends.

    Of the entities only those that the facts mention take part, found from distinct
    ends, so a few heavily used objects make a small side that needs no shuffle of facts.
    """

    def names(end: str) -> DataFrame:
        used = triples.select(F.col(end).alias("id")).distinct()
        return entities.join(used, "id", "left_semi").select(F.col("id").alias(end), F.col("name").alias(f"{end}_label"))

    return triples.join(names("subject"), "subject").join(names("object"), "object")


def _with_entities(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts whose ends both have an entity row; the usually few ends without one are looked up, not the facts."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    missing = ends.join(entities.select("id"), "id", "left_anti")
    subjects, objects = missing.select(F.col("id").alias("subject")), missing.select(F.col("id").alias("object"))
    return triples.join(subjects, "subject", "left_anti").join(objects, "object", "left_anti")


def _shown(facts: DataFrame) -> DataFrame:
    return facts.select(
        F.col("subject_label").alias("subject"), F.col("object_label").alias("object"), *FACT, is_current().alias("current")
    )


def query_relationship(triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    facts = _as_of(triples.where(F.col("predicate") == predicate_id(F.lit(predicate))), as_of)
    return _shown(_named(facts, entities))


def timeline(triples: DataFrame, entities: DataFrame, entity: str | None = None, limit: int | None = TIMELINE_ROWS) -> DataFrame:
    """Oldest facts first, undated last; facts whose endpoints have no entity row do not count."""
    facts = triples
    if entity:
        wanted = entity_id(F.lit(entity))
        facts = facts.where((F.col("subject") == wanted) | (F.col("object") == wanted))
    order = [F.asc_nulls_last("valid_from"), F.asc("subject"), F.asc("predicate"), F.asc("object")]
    first = first_rows(_with_entities(facts, entities).orderBy(*order), limit)
    subjects = entities.select(F.col("id").alias("subject"), F.col("name").alias("subject_label"))
    objects = entities.select(F.col("id").alias("object"), F.col("name").alias("object_label"))
    return _shown(first.join(subjects, "subject").join(objects, "object").orderBy(*order))


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity, fact, current and expired counts with the sorted distinct predicates."""
    total = entities.agg(F.count("*")).scalar()
    per_predicate = triples.groupBy("predicate").agg(
        F.count("*").alias("n"), F.count_if(is_current()).alias("open")
    )
    return per_predicate.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("triples"),
        F.coalesce(F.sum("open"), F.lit(0)).alias("current_facts"),
        F.coalesce(F.sum(F.col("n") - F.col("open")), F.lit(0)).alias("expired_facts"),
        F.array_sort(F.collect_list("predicate")).alias("relationship_types"),
    ).select(total.alias("entities"), "triples", "current_facts", "expired_facts", "relationship_types")


def _month(day: Column) -> Column:
    """Number of the month of a day, growing with the text; NULL for text of another form."""
    number = F.substring(day, 1, 4).cast("int") * 12 + F.substring(day, 6, 2).cast("int") - 1
    return F.when(F.rlike(day, F.lit(r"^[0-9]{4}-(0[1-9]|1[0-2])-")), number)


def _node(level: int, place: Column) -> Column:
    return F.lit(level * LEVEL_PLACES) + place


def _interval_nodes(first: Column, last: Column) -> Column:
    """The fewest spans of 1, 2, 4, ... months that make up the months from ``first`` to ``last``."""
    found = []
    for level in range(MONTH_LEVELS):
        span = 1 << level
        low, high = F.floor((first + span - 1) / span), F.floor((last + 1) / span)
        inside = low < high
        found.append(F.when(inside & (low % 2 == 1), _node(level, low)))
        found.append(F.when(inside & (high % 2 == 1), _node(level, high - 1)))
    return F.array_compact(F.array(*found))


def _month_nodes(month: Column) -> Column:
    return F.array(*[_node(level, F.floor(month / (1 << level))) for level in range(MONTH_LEVELS)])


def as_of_batch(triples: DataFrame, probes: DataFrame, hot_facts: int = HOT_FACTS) -> DataFrame:
    """Facts of every probed ``(subject, day)`` valid that day.

    Most subjects meet in an equi join with the range as residual. Subjects of more than
    ``hot_facts`` facts are cut in time: a fact goes to the spans that make up its interval,
    a probe to the spans around its month, and they share one span at most. Facts of a
    span are dealt into pieces, and a probe visits the pieces that exist. So a subject runs
    in many tasks, and facts of other times are not compared with a probe. Days of another
    form than ``yyyy-mm-dd`` are compared as text, like all others.
    """
    columns = [*triples.columns, *[c for c in probes.columns if c != "subject"]]
    hot = triples.groupBy("subject").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_facts)
    hot = hot.select("subject", F.lit(True).alias("_hot"))
    cut = F.col("_hot").isNotNull()
    facts = triples.join(hot, "subject", "left")
    asked = probes.join(hot, "subject", "left").withColumn("_month", _month(F.col("day")))
    plain = facts.where(~cut).join(asked.where(~cut).drop("_hot"), "subject").where(valid_on(F.col("day")))

    first = F.coalesce(_month(F.col("valid_from")), F.lit(0))
    last = F.coalesce(_month(F.col("valid_to")), F.lit(MONTHS - 1))
    piece = F.pmod(F.xxhash64("predicate", "object", "valid_from", "valid_to"), F.lit(PIECES)).cast("int").alias("_piece")
    nodes = F.posexplode(_interval_nodes(first, last)).alias("_place", "_span")
    spans = facts.where(cut).select(*triples.columns, piece, nodes)
    pieces = spans.select("subject", "_span", "_piece").distinct()
    late = asked.where(cut).drop("_hot")
    dated = late.where(F.col("_month").isNotNull()).withColumn("_span", F.explode(_month_nodes(F.col("_month"))))
    visits = dated.join(pieces, ["subject", "_span"])
    # A day without a month looks at the first span of every fact.
    visits = visits.unionByName(late.where(F.col("_month").isNull()).join(pieces, "subject"))
    met = spans.join(visits, ["subject", "_span", "_piece"])
    once = F.col("_month").isNotNull() | (F.col("_place") == 0)
    return plain.select(columns).unionByName(met.where(once & valid_on(F.col("day"))).select(columns))


def latest_entities(incoming: DataFrame) -> DataFrame:
    """One row per id of ``incoming``: that of the largest ``ord``."""
    return (
        incoming.withColumn("id", entity_id(F.col("name")))
        .groupBy("id")
        .agg(F.max_by(F.struct("name", "type"), "ord").alias("row"))
        .select("id", "row.name", "row.type")
    )


def upsert_entities(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace the whole row of every id in ``incoming``; its largest ``ord`` wins per id."""
    latest = latest_entities(incoming)
    columns = ["id", "name", "type"]
    return entities.select(columns).join(latest, "id", "left_anti").unionByName(latest.select(columns))


def missing_endpoints(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Every fact endpoint that has no row yet, typed 'unknown'.

    ``facts`` carries display names as ``subject_name`` / ``object_name``; the smallest
    spelling names a new node.
    """
    ends = facts.select(F.explode(F.array("subject_name", "object_name")).alias("name"))
    return (
        ends.groupBy(entity_id(F.col("name")).alias("id"))
        .agg(F.min("name").alias("name"))
        .join(entities.select("id"), "id", "left_anti")
        .withColumn("type", F.lit("unknown"))
    )


def add_missing_endpoints(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities plus every fact endpoint that has no row yet."""
    return entities.select("id", "name", "type").unionByName(missing_endpoints(entities, facts))


def add_triples(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that are really new: no open fact with the same ids exists, the first of equal ones wins.

    ``facts`` has ``(subject_name, predicate, object_name, valid_from, ord)``. A closed
    fact may be added again. When several equal facts arrive together, the ones before
    and including the first open one are inserted, in ``ord`` order.
    """
    key = ["subject", "predicate", "object"]
    incoming = facts.select(
        entity_id(F.col("subject_name")).alias("subject"),
        predicate_id(F.col("predicate")).alias("predicate"),
        entity_id(F.col("object_name")).alias("object"),
        "valid_from",
        F.col("valid_to") if "valid_to" in facts.columns else F.lit(None).cast("string").alias("valid_to"),
        "ord",
    )
    open_facts = triples.where(is_current()).select(key).distinct()
    fresh = incoming.join(open_facts, key, "left_anti")
    first_open = fresh.where(is_current()).groupBy(key).agg(F.min("ord").alias("first_open"))
    return (
        fresh.join(first_open, key, "left")
        .where(F.col("first_open").isNull() | (F.col("ord") <= F.col("first_open")))
        .drop("first_open")
    )


def closings(ended: DataFrame, default_day: str | None = None) -> DataFrame:
    """``(subject, predicate, object, closed_on)``: the earliest named day per fact of ``ended``."""
    day = F.coalesce(F.col("ended"), F.lit(default_day) if default_day else F.date_format(F.current_date(), "yyyy-MM-dd"))
    return (
        ended.select(
            entity_id(F.col("subject_name")).alias("subject"),
            predicate_id(F.col("predicate")).alias("predicate"),
            entity_id(F.col("object_name")).alias("object"),
            day.alias("closed_on"),
        )
        .groupBy("subject", "predicate", "object")
        .agg(F.min("closed_on").alias("closed_on"))
    )


def invalidate(triples: DataFrame, ended: DataFrame, default_day: str | None = None) -> DataFrame:
    """Close all open facts named in ``ended`` ``(subject_name, predicate, object_name, ended)``."""
    return (
        triples.join(closings(ended, default_day), ["subject", "predicate", "object"], "left")
        .withColumn("valid_to", F.coalesce("valid_to", "closed_on"))
        .drop("closed_on")
    )


def change_outcomes(triples: DataFrame, entities: DataFrame, requests: DataFrame, strict_spelling: bool = False) -> DataFrame:
    """What each add or invalidate request will do: ``noop`` or ``success`` with the reason.

    ``requests`` has ``(operation, subject_name, predicate, object_name)``. By default
    the open fact is found by ids; ``strict_spelling`` also compares the stored display
    name of the object letter by letter, which reports a differently cased object as
    already invalidated.
    """
    key = ["subject", "predicate", "object"]
    names = entities.select(F.col("id").alias("object"), F.col("name").alias("stored_name"))
    asked = requests.select(
        "*",
        entity_id(F.col("subject_name")).alias("subject"),
        predicate_id(F.col("predicate")).alias("predicate_id"),
        entity_id(F.col("object_name")).alias("object"),
    )
    wanted = asked.select("subject", F.col("predicate_id").alias("predicate"), "object").distinct()
    # Only facts that some request names go on to the names.
    open_facts = triples.where(is_current()).select(key).join(wanted, key, "left_semi").distinct().join(names, "object")
    found = F.col("stored_name").isNotNull()
    if strict_spelling:
        found = found & (F.col("stored_name") == F.col("object_name"))
    adding = F.col("operation") == "kg_add"
    return (
        asked.join(open_facts.withColumnRenamed("predicate", "predicate_id"), ["subject", "predicate_id", "object"], "left")
        .select(
            "operation",
            "subject_name",
            "predicate",
            "object_name",
            F.when(adding & found, "already_exists").when(~adding & ~found, "already_invalidated").otherwise("").alias("reason"),
        )
        .withColumn("phase", F.when(F.col("reason") == "", "success").otherwise("noop"))
    )


