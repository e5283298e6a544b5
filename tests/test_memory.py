from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnlake.memory import Memory
from cairnlake.plans import sql_api
from cairnlake.sources import files
from cairnlake.sources.store import Collections

REQUEST = "wing string, room string, content string, source_file string, added_by string"


def test_memory_tools_end_to_end(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS mem")
    memory = Memory(spark, "mem", str(tmp_path / "journal"))
    assert memory.status().first()["n"] == 0
    asked = spark.createDataFrame(
        [
            ("Proj", "Backend", "JWT tokens guard the session endpoints", "auth.py", None),
            ("Notes", "Planning", "Sprint planning for the passkey migration", "plan.md", None),
        ],
        REQUEST,
    )
    assert {r["outcome"] for r in memory.add_drawer(asked).collect()} == {"inserted"}
    assert {r["outcome"] for r in memory.add_drawer(asked).collect()} == {"noop"}
    near = spark.createDataFrame([("proj", "misc", "session endpoints guard tokens", None, None)], REQUEST)
    assert memory.add_drawer(near).first()["outcome"] == "duplicate"
    assert memory.search("jwt tokens").first()["similarity"] == 1.0
    assert memory.check_duplicate("passkey migration planning").count() == 1
    assert {r["wing"]: r["n"] for r in memory.list_wings().collect()} == {"proj": 1, "notes": 1}
    assert memory.list_rooms("proj").first()["room"] == "backend"
    memory.register_sql()
    assert [r["wing"] for r in spark.sql("SELECT * FROM memory_search('jwt tokens')").collect()] == ["proj"]
    assert spark.sql("SELECT * FROM memory_wings()").count() == 2
    assert memory.get_taxonomy().count() == 2
    memory.diary_write(spark.createDataFrame([("Owl", None, "kept notes")], "agent string, topic string, entry string"))
    assert memory.diary_read("owl").first()["content"] == "kept notes"
    assert memory.graph_stats().first()["total_rooms"] == 3
    assert [r["room"] for r in memory.traverse("back").collect()] == ["backend"]
    assert memory.traverse("backend").first()["hop"] == 0
    assert memory.find_tunnels().count() == 0
    assert "ESSENTIAL STORY" in memory.wake_up("I am here")
    assert memory.compress().first()["drawers"] == 3
    memory.repair()
    assert memory.store.list() == ["compressed", "drawers"]
    gone = memory.search("jwt").select("id")
    assert memory.delete_drawer(gone).first()["outcome"] == "success"
    assert memory.search("jwt").count() == 0


def test_memory_facts(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS facts")
    memory = Memory(spark, "facts")
    schema = "subject_name string, predicate string, object_name string, valid_from string, ord int"
    memory.kg_add(spark.createDataFrame([("Alice", "works at", "Acme", "2020-01-01", 1), ("Max", "does", "chess", None, 2)], schema))
    memory.kg_add(spark.createDataFrame([("alice", "Works At", "acme", "2021-01-01", 1)], schema))
    assert memory.kg_stats().first()["triples"] == 2
    memory.kg_invalidate(spark.createDataFrame([("Alice", "works at", "Acme", "2024-12-31")], "subject_name string, predicate string, object_name string, ended string"))
    assert memory.kg_query("Alice", as_of="2025-01-01").count() == 0
    assert memory.kg_query("Acme", as_of="2024-12-31").first()["direction"] == "incoming"
    memory.kg_add_entity(spark.createDataFrame([("Alice", "person", 1)], "name string, type string, ord int"))
    assert memory.kg_stats().first()["entities"] == 4
    assert [r["subject"] for r in memory.kg_timeline().collect()] == ["Alice", "Max"]
    with pytest.raises(ValueError):
        memory.kg_query("Alice", direction="up")


def test_sql_functions(spark):
    sql_api.register_functions(spark)
    row = spark.sql(
        """SELECT memory_tokens('The café foo_1') AS t, memory_containment('a b', 'b c') AS c, memory_half_even(0.0625D, 3) AS h,
        memory_entity_id("Alice O'Neil") AS e, memory_valid_on(NULL, '2024-01-01', '2024-01-01') AS v"""
    ).first()
    assert (row["t"], row["c"], row["h"], row["e"], row["v"]) == (["the", "foo_1"], 0.5, 0.062, "alice_oneil", True)


def test_sessions_are_written_as_text(spark, tmp_path):
    df = spark.createDataFrame([("a__part01.txt", "one\ntwo")], "file_name string, content string")
    files.write_sessions(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "file_name=a__part01.txt").glob("part-*")
    assert part.read_text() == "one\ntwo\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("whole\ntext")
    assert files.read_sessions(spark, str(tmp_path / "in")).first()["content"] == "whole\ntext"


def test_a_change_leaves_earlier_files_alone(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS wings")
    store = Collections(spark, "wings")
    rows = [(f"d{n}", f"text {n}", f"w{n % 3}", "room", f"s{n}") for n in range(12)] + [("o", "odd", "it's", "room", "so")]
    store.add("drawers", spark.createDataFrame(rows, "id string, text string, wing string, room string, source_file string"))
    first = store.table("drawers").manifest()
    store.delete("drawers", spark.createDataFrame([("d1",), ("o",)], "id string"))
    assert store.table("drawers").manifest().data == first.data
    store.delete_sources("drawers", spark.createDataFrame([("S2",)], "source_file string"))
    moved = spark.createDataFrame([("d5", "moved", "w1", "room", "s5")], "id string, text string, wing string, room string, source_file string")
    store.upsert("drawers", moved)
    assert store.table("drawers").manifest().data[: len(first.data)] == first.data
    assert store.read("drawers").count() == 10
    assert store.read("drawers").where("id = 'd5'").first()["wing"] == "w1"
    store.repair("drawers")
    ids = [r["id"] for r in store.read("drawers").where("wing = 'w0'").collect()]
    assert ids == sorted(ids) and len(ids) == 4
