"""The engine from SQL: temporary views of the tables, functions for the basic rules, table functions for the tools.

A table function is a query over the views with parameters. The optimizer puts the
arguments in, so filters reach the scan and ``most`` becomes a top-k.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cairnlake.functions.params import DUPLICATE_THRESHOLD, GROUP_LIMIT, HOPS_LIMIT, SEARCH_LIMIT
from cairnlake.functions.text import TOKEN_PATTERN
from cairnlake.operators import roomgraph
from cairnlake.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHUNK, text_pieces
from cairnlake.operators.knowledge import TIMELINE_ROWS
from cairnlake.operators.search import DUPLICATE_MATCHES
from cairnlake.sources import tables

FUNCTIONS = {
    "memory_tokens(text STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(lower(text), r'{TOKEN_PATTERN}', 0)",
    "memory_containment(query STRING, text STRING) RETURNS DOUBLE": (
        "CASE WHEN size(memory_tokens(query)) = 0 THEN 0.0D ELSE "
        "size(array_intersect(memory_tokens(query), memory_tokens(text))) / CAST(size(array_distinct(memory_tokens(query))) AS DOUBLE) END"
    ),
    "memory_half_even(value DOUBLE, places INT) RETURNS DOUBLE": "rint(value * power(10, places)) / power(10, places)",
    "memory_entity_id(name STRING) RETURNS STRING": "replace(replace(lower(name), ' ', '_'), '\\'', '')",
    "memory_valid_on(valid_from STRING, valid_to STRING, day STRING) RETURNS BOOLEAN": (
        "(valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR valid_to >= day)"
    ),
}


def _clamped(value: str, bounds: tuple[int, int]) -> str:
    return f"CASE WHEN {value} IS NULL OR {value} <= 0 THEN {bounds[0]} ELSE least({value}, {bounds[1]}) END"


def _first(query: str, order: str, most: str) -> str:
    """The first rows of a query; the planner makes a top-k of it."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({query})) WHERE place <= {most}"


_SCOPE = "({0}.in_wing IS NULL OR wing = {0}.in_wing) AND ({0}.in_room IS NULL OR room = {0}.in_room)"
_FACT = "predicate, valid_from, valid_to, confidence, valid_to IS NULL AS is_current"
_FACT_COLUMNS = "predicate STRING, valid_from STRING, valid_to STRING, confidence DOUBLE, is_current BOOLEAN"
_NAMED_FACTS = f"""SELECT t.subject AS subject_id, t.object AS object_id, s.name AS subject, o.name AS object, {_FACT}
FROM memory_triples t JOIN memory_entities s ON t.subject = s.id JOIN memory_entities o ON t.object = o.id"""
_SEARCHED = f"""SELECT id, text, wing, room, source_file, memory_containment(memory_search.query, text) AS score
FROM memory_drawers WHERE {_SCOPE.format("memory_search")}"""
_COMPARED = "SELECT id, wing, room, text, memory_containment(memory_duplicates.content, text) AS score FROM memory_drawers"
_THRESHOLD = f"CASE WHEN isnan(memory_duplicates.threshold) OR abs(memory_duplicates.threshold) = double('infinity') THEN {DUPLICATE_THRESHOLD}D ELSE greatest(0.0D, least(1.0D, memory_duplicates.threshold)) END"
_TUNNELS = """SELECT * FROM memory_rooms_graph WHERE size(wings) >= 2
AND (memory_tunnels.wing_a IS NULL OR array_contains(wings, memory_tunnels.wing_a))
AND (memory_tunnels.wing_b IS NULL OR array_contains(wings, memory_tunnels.wing_b))"""


def _facts_of(own: str, other: str, label: str) -> str:
    """Facts around an asked entity from one side; the asked side shows the caller's spelling."""
    subject, obj = ("memory_kg_query.entity", "name") if own == "subject" else ("name", "memory_kg_query.entity")
    return f"""SELECT '{label}' AS direction, {subject} AS subject, {obj} AS object, {_FACT}
FROM memory_triples t JOIN memory_entities e ON t.{other} = e.id
WHERE t.{own} = memory_entity_id(memory_kg_query.entity) AND memory_kg_query.direction IN ('{label}', 'both')
AND (coalesce(memory_kg_query.day, '') = '' OR memory_valid_on(valid_from, valid_to, memory_kg_query.day))"""


def _walk() -> str:
    """Rooms by the number of shared wings it takes to reach them, one reduced round per hop.

    A round joins the wings seen so far, each once, so a wing shared by many rooms costs rows.
    """
    wings = "SELECT room, explode(wings) AS wing FROM memory_rooms_graph"
    parts = [f"edges AS ({wings})", "rooms0 AS (SELECT room, 0 AS hop FROM memory_rooms_graph WHERE room = memory_traverse.start_room)"]
    for hop in range(1, HOPS_LIMIT[0] + 1):
        parts.append(f"wings{hop} AS (SELECT DISTINCT wing FROM edges LEFT SEMI JOIN rooms{hop - 1} USING (room))")
        met = f"SELECT room, {hop} AS hop FROM edges LEFT SEMI JOIN wings{hop} USING (wing)"
        parts.append(f"rooms{hop} AS (SELECT room, min(hop) AS hop FROM (SELECT * FROM rooms{hop - 1} UNION ALL {met}) GROUP BY room)")
    last = f"rooms{HOPS_LIMIT[0]}"
    hops = _clamped("memory_traverse.hops", (HOPS_LIMIT[0], HOPS_LIMIT[0]))
    return f"WITH {', '.join(parts)} SELECT g.room, g.wings, g.n, r.hop FROM {last} r JOIN memory_rooms_graph g ON g.room = r.room WHERE r.hop <= {hops}"


_SIMILARITY = "memory_half_even(score, 3)"
TABLE_FUNCTIONS = {
    "memory_get_drawers(in_wing STRING DEFAULT NULL, in_room STRING DEFAULT NULL) RETURNS TABLE (id STRING, text STRING, wing STRING, room STRING, source_file STRING)": (
        f"SELECT id, text, wing, room, source_file FROM memory_drawers WHERE {_SCOPE.format('memory_get_drawers')}"
    ),
    f"memory_search(query STRING, most INT DEFAULT {SEARCH_LIMIT[0]}, in_wing STRING DEFAULT NULL, in_room STRING DEFAULT NULL) RETURNS TABLE (place INT, id STRING, text STRING, wing STRING, room STRING, source_file STRING, similarity DOUBLE)": (
        f"SELECT place, id, text, wing, room, substring_index(source_file, '/', -1), {_SIMILARITY} FROM "
        f"({_first(_SEARCHED, 'score DESC, source_file, id', _clamped('memory_search.most', SEARCH_LIMIT))}) "
        "WHERE score > 0 OR size(memory_tokens(memory_search.query)) = 0"
    ),
    f"memory_duplicates(content STRING, threshold DOUBLE DEFAULT {DUPLICATE_THRESHOLD}D) RETURNS TABLE (place INT, id STRING, wing STRING, room STRING, similarity DOUBLE)": (
        f"SELECT place, id, wing, room, {_SIMILARITY} FROM ({_first(_COMPARED, 'score DESC, id', str(DUPLICATE_MATCHES))}) "
        f"WHERE score >= {_THRESHOLD}"
    ),
    "memory_wings() RETURNS TABLE (wing STRING, n BIGINT)": (
        "SELECT wing, n FROM (" + _first("SELECT wing, count(*) AS n FROM memory_drawers GROUP BY wing", "n DESC, wing", str(GROUP_LIMIT)) + ")"
    ),
    "memory_rooms(in_wing STRING DEFAULT NULL) RETURNS TABLE (wing STRING, room STRING, n BIGINT)": (
        "SELECT coalesce(memory_rooms.in_wing, 'all'), room, n FROM ("
        + _first(
            "SELECT room, count(*) AS n FROM memory_drawers WHERE memory_rooms.in_wing IS NULL OR wing = memory_rooms.in_wing GROUP BY room",
            "n DESC, room",
            str(GROUP_LIMIT),
        )
        + ")"
    ),
    f"memory_kg_query(entity STRING, day STRING DEFAULT NULL, direction STRING DEFAULT 'both') RETURNS TABLE (direction STRING, subject STRING, object STRING, {_FACT_COLUMNS})": (
        f"{_facts_of('subject', 'object', 'outgoing')} UNION ALL {_facts_of('object', 'subject', 'incoming')}"
    ),
    f"memory_kg_relationship(relation STRING, day STRING DEFAULT NULL) RETURNS TABLE (subject STRING, object STRING, {_FACT_COLUMNS})": (
        f"SELECT subject, object, predicate, valid_from, valid_to, confidence, is_current FROM ({_NAMED_FACTS}) "
        "WHERE predicate = replace(lower(memory_kg_relationship.relation), ' ', '_') "
        "AND (coalesce(memory_kg_relationship.day, '') = '' OR memory_valid_on(valid_from, valid_to, memory_kg_relationship.day))"
    ),
    f"memory_kg_timeline(entity STRING DEFAULT NULL) RETURNS TABLE (place INT, subject STRING, object STRING, {_FACT_COLUMNS})": (
        "SELECT place, subject, object, predicate, valid_from, valid_to, confidence, is_current FROM ("
        + _first(
            f"SELECT * FROM ({_NAMED_FACTS}) WHERE coalesce(memory_kg_timeline.entity, '') = '' "
            "OR memory_entity_id(memory_kg_timeline.entity) IN (subject_id, object_id)",
            "valid_from ASC NULLS LAST, subject_id, predicate, object_id",
            str(TIMELINE_ROWS),
        )
        + ")"
    ),
    "memory_tunnels(wing_a STRING DEFAULT NULL, wing_b STRING DEFAULT NULL) RETURNS TABLE (place INT, room STRING, wings ARRAY<STRING>, n BIGINT)": (
        f"SELECT place, room, wings, n FROM ({_first(_TUNNELS, 'n DESC, first_id', str(roomgraph.TUNNEL_ROWS))})"
    ),
    "memory_graph_stats() RETURNS TABLE (total_rooms BIGINT, tunnel_rooms BIGINT, total_edges BIGINT)": (
        "SELECT count(*), count_if(size(wings) >= 2), "
        "coalesce(sum(bigint(size(wings)) * (size(wings) - 1) div 2 * size(halls)), 0) FROM memory_rooms_graph"
    ),
    "memory_traverse(start_room STRING, hops INT DEFAULT NULL) RETURNS TABLE (room STRING, wings ARRAY<STRING>, n BIGINT, hop INT)": _walk(),
}


class TextChunks:
    """``memory_chunks(TABLE(t), text_column => 'text')``: the other columns of the table, ``chunk_index`` and ``content``."""

    @staticmethod
    def analyze(
        rows: AnalyzeArgument,
        text_column: AnalyzeArgument | None = None,
        size: AnalyzeArgument | None = None,
        overlap: AnalyzeArgument | None = None,
        minimum: AnalyzeArgument | None = None,
    ) -> AnalyzeResult:
        name = text_column.value if text_column is not None else "text"
        if not rows.isTable or name not in rows.dataType.names:
            raise ValueError(f"memory_chunks needs a table with a column {name}")
        schema = T.StructType([field for field in rows.dataType.fields if field.name != name])
        return AnalyzeResult(schema.add("chunk_index", T.IntegerType()).add("content", T.StringType()))

    def eval(
        self, row: Row, text_column: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, minimum: int = MIN_CHUNK
    ) -> Iterator[tuple[Any, ...]]:
        kept = [value for name, value in row.asDict(recursive=False).items() if name != text_column]
        for number, piece in enumerate(text_pieces(row[text_column] or "", size, overlap, minimum)):
            yield (*kept, number, piece)


def register_functions(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_table_functions(spark: SparkSession) -> None:
    """The tools as table functions over the views, which must be registered before."""
    register_functions(spark)
    for signature, body in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("memory_chunks", udtf(TextChunks))


def register_frames(drawers: DataFrame, triples: DataFrame, entities: DataFrame) -> None:
    """Views of any drawers, facts and entities; ``memory_rooms_graph`` is derived from the drawers."""
    drawers.createOrReplaceTempView("memory_drawers")
    triples.createOrReplaceTempView("memory_triples")
    entities.createOrReplaceTempView("memory_entities")
    roomgraph.room_nodes(drawers).createOrReplaceTempView("memory_rooms_graph")


def register_views(spark: SparkSession, folder: str) -> None:
    """Views ``memory_drawers``, ``memory_triples``, ``memory_entities``, ``memory_rooms_graph``, ``memory_messages``, ``memory_vectors``."""
    register_frames(tables.drawers(spark, folder, labelled=True), tables.triples(spark, folder), tables.entities(spark, folder))
    tables.messages(spark, folder).createOrReplaceTempView("memory_messages")
    tables.vectors(spark, folder).createOrReplaceTempView("memory_vectors")
