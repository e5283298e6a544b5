"""Every table function against the operator that it stands for."""

from __future__ import annotations

from pathlib import Path

import pytest

from cairnlake.operators import chunking, knowledge, roomgraph, search, taxonomy
from cairnlake.plans import sql_api
from cairnlake.sources import tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the analytics tables")


@pytest.fixture(scope="module")
def made(spark):
    sql_api.register_views(spark, FOLDER)
    sql_api.register_table_functions(spark)
    return {name: spark.table(f"memory_{name}") for name in ("drawers", "triples", "entities", "rooms_graph")}


def _rows(df, *columns):
    found = df.select(*columns) if columns else df
    return sorted(str(tuple(row)) for row in found.collect())


def test_drawers_and_counts(spark, made):
    plain = search.get_drawers(made["drawers"], "en", "general")
    assert _rows(spark.sql("SELECT id FROM memory_get_drawers('en', 'general')")) == _rows(plain, "id") != []
    assert spark.sql("SELECT * FROM memory_get_drawers()").count() == made["drawers"].count()
    assert _rows(spark.sql("SELECT * FROM memory_wings()")) == _rows(taxonomy.list_wings(made["drawers"]))
    assert _rows(spark.sql("SELECT * FROM memory_rooms('de')")) == _rows(taxonomy.list_rooms(made["drawers"], "de"))
    assert _rows(spark.sql("SELECT * FROM memory_rooms()")) == _rows(taxonomy.list_rooms(made["drawers"]))


@pytest.mark.parametrize("query, most, wing", [("the price of the house", 7, None), ("la casa de", -1, "es"), ("zzz", 5, None), ("...", 99, "en")])
def test_search(spark, made, query, most, wing):
    names = ["id", "wing", "room", "source_file", "similarity"]
    given = f"'{query}', {most}" + (f", in_wing => '{wing}'" if wing else "")
    got = spark.sql(f"SELECT * FROM memory_search({given})")
    assert _rows(got, *names) == _rows(search.search_memories(made["drawers"], query, most, wing), *names)


def test_duplicates(spark, made):
    text = made["drawers"].where("length(text) > 60").orderBy("id").first()["text"][:50].replace("'", " ")
    names = ["id", "wing", "room", "similarity"]
    for threshold in (0.9, 0.2, -1.0):
        got = spark.sql(f"SELECT * FROM memory_duplicates('{text}', {threshold}D)")
        assert _rows(got, *names) == _rows(search.check_duplicate(made["drawers"], text, threshold), *names) != []


def test_facts(spark, made):
    both = (made["triples"], made["entities"])
    name = made["triples"].join(made["entities"].withColumnRenamed("id", "subject"), "subject").orderBy("subject").first()["name"]
    for day in (None, "2023-06-01"):
        given = f"'{name}'" if day is None else f"'{name}', '{day}'"
        assert _rows(spark.sql(f"SELECT * FROM memory_kg_query({given})")) == _rows(knowledge.query_entity(*both, name, day, "both"))
        given = "'Placed'" if day is None else f"'Placed', '{day}'"
        assert _rows(spark.sql(f"SELECT * FROM memory_kg_relationship({given})")) == _rows(knowledge.query_relationship(*both, "Placed", day)) != []
    assert spark.sql(f"SELECT * FROM memory_kg_query('{name}', direction => 'sideways')").count() == 0
    shown = ["subject", "object", "predicate", "valid_from"]
    assert _rows(spark.sql("SELECT * FROM memory_kg_timeline()"), *shown) == _rows(knowledge.timeline(*both), *shown)
    assert _rows(spark.sql(f"SELECT * FROM memory_kg_timeline('{name}')"), *shown) == _rows(knowledge.timeline(*both, name), *shown) != []


def test_rooms_graph(spark, made):
    nodes = made["rooms_graph"]
    assert _rows(spark.sql("SELECT * FROM memory_graph_stats()")) == _rows(roomgraph.graph_stats(nodes))
    for given, wings in (("", (None, None)), ("'en'", ("en", None)), ("wing_b => 'de'", (None, "de"))):
        got = spark.sql(f"SELECT * FROM memory_tunnels({given})")
        assert _rows(got, "room", "wings", "n") == _rows(roomgraph.find_tunnels(nodes, *wings), "room", "wings", "n")
    start = nodes.where("size(wings) = 1").orderBy("room").first()["room"]
    for hops in (1, 2):
        got = spark.sql(f"SELECT * FROM memory_traverse('{start}', {hops})")
        assert _rows(got, "room", "n", "hop") == _rows(roomgraph.traverse(nodes, start, hops, limit=None), "room", "n", "hop") != []
    assert spark.sql("SELECT * FROM memory_traverse('nowhere')").count() == 0


def test_chunks_of_a_table(spark, made):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    docs.createOrReplaceTempView("chunk_input")
    got = spark.sql("SELECT * FROM memory_chunks(TABLE(chunk_input))")
    assert got.columns == ["doc_id", "lang", "chunk_index", "content"]
    assert _rows(got) == _rows(chunking.chunk_text(docs))
    small = spark.sql("SELECT * FROM memory_chunks(TABLE(SELECT doc_id, text AS body FROM chunk_input), text_column => 'body', size => 200, overlap => 20, minimum => 5)")
    assert _rows(small) == _rows(chunking.chunk_text(docs.select("doc_id", "text"), "text", 200, 20, 5))
