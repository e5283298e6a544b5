"""Append-only operation journal as JSON lines, and its running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL_SCHEMA = "timestamp string, operation string, phase string, drawer_id string, wing string, room string"


def append_journal(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Streaming source over the journal folder."""
    return spark.readStream.schema(JOURNAL_SCHEMA).json(path)


def phase_counts(entries: DataFrame) -> DataFrame:
    """Entries per operation and phase; works on a batch and on a stream."""
    return entries.groupBy("operation", "phase").agg(F.count("*").alias("n"))
