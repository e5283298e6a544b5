from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnlake.memory import Memory
from cairnlake.plans import migrate
from cairnlake.schema import DRAWER_SCHEMA
from cairnlake.sources.versions import VersionedTable

SCHEMA = "id string, text string, wing string, room string"


@pytest.fixture
def table(spark, tmp_path):
    held = VersionedTable(spark, str(tmp_path / "drawers"), DRAWER_SCHEMA, ["id"], ["wing", "id"])
    held.commit(spark.createDataFrame([("old", "old text", "w", "r")], SCHEMA))
    return held


def moved(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def texts(table):
    return {r["id"]: r["text"] for r in table.read().collect()}


def test_dry_run_and_empty_source_write_nothing(spark, table):
    report = migrate.migrate(table, moved(spark, ("a", "x", "w", " "), ("b", "y", "w", "r")), dry_run=True)
    assert (report.drawers, report.imported, report.version) == (2, 0, 0)
    assert {(r["wing"], r["room"], r["n"]) for r in report.summary.collect()} == {("w", "?", 1), ("w", "r", 1)}
    assert migrate.migrate(table, spark.createDataFrame([], SCHEMA)).version == 0
    assert table.versions() == [1] and texts(table) == {"old": "old text"}


def test_migration_switches_and_can_be_taken_back(spark, table):
    report = migrate.migrate(table, moved(spark, ("a", "x", "w", "r"), ("a", "z", "w", "r"), ("b", "y", "v", "r")))
    assert (report.drawers, report.imported, report.version, report.backup) == (3, 2, 2, 1)
    assert texts(table) == {"a": "x", "b": "y"}
    table.rollback(report.backup)
    assert texts(table) == {"old": "old text"}


def test_a_failed_run_leaves_the_table(spark, table, monkeypatch):
    source = moved(spark, ("a", "x", "w", "r"), ("b", "y", "v", "r"))
    stage = table.stage
    with monkeypatch.context() as patch:
        patch.setattr(table, "stage", lambda rows, afresh: stage(rows.where("id <> 'b'"), afresh=afresh))
        with pytest.raises(migrate.MigrationError):
            migrate.migrate(table, source)
    with pytest.raises(migrate.MigrationError):
        migrate.migrate(table, source.withColumn("text", F.when(F.col("id") == "a", F.col("text"))))
    assert texts(table) == {"old": "old text"} and table.versions() == [1]
    assert migrate.migrate(table, source).imported == 2


def test_memory_migrates_with_its_index(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS moved")
    memory = Memory(spark, "moved")
    memory.migrate(moved(spark, ("a", "quiet river", "w", "r"), ("b", "loud street", "w", "r")))
    assert memory.search("river").first()["id"] == "a"
    assert memory.check_duplicate("loud street").first()["id"] == "b"
    assert memory.migrate(moved(spark, ("c", "x", "w", "r")), dry_run=True).count() == 1
    assert memory.search("street").first()["id"] == "b"
