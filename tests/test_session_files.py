from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnlake.sources import session_files

SCHEMA = "path string, number int, file_name string, content string"


def test_sessions_of_one_name_both_exist_and_sources_are_set_aside(spark, tmp_path):
    for name in ("a.log", "b"):
        (tmp_path / name).write_text("source")
    rows = [
        (str(tmp_path / "b"), 1, "s__part01.txt", "third"),
        (str(tmp_path / "a.log"), 1, "s__part01.txt", "first\nline"),
        (str(tmp_path / "a.log"), 2, "ünï =%.txt", "second"),
    ]
    out = tmp_path / "out"
    report = session_files.save_sessions(spark.createDataFrame(rows, SCHEMA), str(out))
    assert (report.sessions, report.sources) == (3, 2)
    texts = {path.name: path.read_text() for path in out.iterdir() if not path.name.startswith(".")}
    assert texts.pop("s__part01.txt") == "first\nline\n" and texts.pop("ünï =%.txt") == "second\n"
    assert list(texts.values()) == ["third\n"] and next(iter(texts)).startswith("s__part01-2-")
    assert not (tmp_path / "a.log").exists() and (tmp_path / "a.mega_backup").read_text() == "source"
    assert (tmp_path / "b.mega_backup").exists()


def test_a_second_run_replaces_its_own_files(spark, tmp_path):
    source = tmp_path / "a.txt"
    for text in ("old", "new"):
        source.write_text("x")
        session_files.save_sessions(spark.createDataFrame([(str(source), 1, "s.txt", text)], SCHEMA), str(tmp_path / "out"))
    assert (tmp_path / "out" / "s.txt").read_text() == "new\n" and (tmp_path / "a.mega_backup").exists()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    source = tmp_path / "a.txt"
    source.write_text("x")
    bad = spark.createDataFrame([(str(source), 1, "s.txt", "text")], SCHEMA).withColumn("content", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        session_files.save_sessions(bad, str(tmp_path / "out"))
    assert source.exists() and not list((tmp_path / "out").glob("*")) if (tmp_path / "out").exists() else source.exists()


def test_no_sessions(spark, tmp_path):
    report = session_files.save_sessions(spark.createDataFrame([], SCHEMA), str(tmp_path / "out"))
    assert (report.sessions, report.sources) == (0, 0)
