from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.memory import Memory
from cairnlake.sources.versions import ConflictError, VersionedTable

SCHEMA = T.StructType().add("id", "string").add("wing", "string").add("n", "integer")


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], ["wing", "id"])


def rows(table, version=None):
    return {tuple(r) for r in table.read(version).collect()}


def frame(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def bytes_below(folder):
    return sum(path.stat().st_size for path in folder.rglob("*.parquet"))


def test_steps_add_take_away_and_bring_back(spark, table):
    assert not table.exists() and rows(table) == set()
    table.commit(frame(spark, ("a", "w", 1), ("b", "w", 2), (None, "v", 3)))
    table.commit(gone=frame(spark, ("a", None, None), ("zz", None, None)))
    assert rows(table) == {("b", "w", 2), (None, "v", 3)}
    table.commit(frame(spark, ("a", "x", 4), ("b", "x", 5)), gone=frame(spark, ("b", None, None), (None, None, None)))
    assert rows(table) == {("a", "x", 4), ("b", "x", 5)}
    assert rows(table, 1) == {("a", "w", 1), ("b", "w", 2), (None, "v", 3)}
    before = rows(table)
    assert table.compact() == 4 and rows(table) == before and table.manifest().gone == ()
    table.rollback(2)
    assert rows(table) == {("b", "w", 2), (None, "v", 3)} and table.versions() == [1, 2, 3, 4, 5]
    assert table.vacuum() == 3 and rows(table) == {("b", "w", 2), (None, "v", 3)}


def test_a_change_that_stops_before_the_switch_leaves_the_old_version(spark, table, monkeypatch):
    table.commit(frame(spark, ("a", "w", 1)))

    def stop(staged):
        raise OSError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(table, "switch", stop)
        with pytest.raises(OSError):
            table.commit(frame(spark, ("b", "w", 2)), gone=frame(spark, ("a", None, None)))
    assert rows(table) == {("a", "w", 1)} and table.versions() == [1]
    table.commit(frame(spark, ("b", "w", 2)))
    assert rows(table) == {("a", "w", 1), ("b", "w", 2)}


def test_the_second_of_two_writers_fails(spark, table):
    table.commit(frame(spark, ("a", "w", 1)))
    staged = table.stage(frame(spark, ("b", "w", 2)))
    table.commit(frame(spark, ("c", "w", 3)))
    with pytest.raises(ConflictError):
        table.switch(staged)
    assert rows(table) == {("a", "w", 1), ("c", "w", 3)}


def test_a_change_writes_bytes_in_proportion(spark, table, tmp_path):
    table.commit(spark.range(50000).select(F.md5(F.col("id").cast("string")).alias("id"), F.lit("w").alias("wing"), F.col("id").cast("int").alias("n")))
    whole = bytes_below(tmp_path)
    table.commit(gone=table.read().limit(1))
    assert bytes_below(tmp_path) - whole < whole / 100
    assert table.read().count() == 49999


def test_one_fact_and_one_drawer_write_little(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS little")
    memory = Memory(spark, "little")
    schema = "subject_name string, predicate string, object_name string, valid_from string, ord int"
    many = spark.range(3000).select(
        F.concat(F.lit("s"), "id").alias("subject_name"), F.lit("knows").alias("predicate"), F.concat(F.lit("o"), "id").alias("object_name"),
        F.lit("2020-01-01").alias("valid_from"), F.col("id").cast("int").alias("ord"),
    )
    memory.kg_add(many)
    before = memory._facts().manifest()
    memory.kg_add(spark.createDataFrame([("Alice", "knows", "Bob", None, 1)], schema))
    memory.kg_invalidate(spark.createDataFrame([("s1", "knows", "o1", "2021-01-01")], "subject_name string, predicate string, object_name string, ended string"))
    after = memory._facts().manifest()
    assert after.data[:1] == before.data and [spark.read.parquet(folder).count() for folder in after.data[1:]] == [1, 1]
    assert memory.kg_stats().first()["triples"] == 3001
    memory.repair()
    assert memory.kg_stats().first()["expired_facts"] == 1 and len(memory._facts().manifest().data) == 1
