"""Helpers for the frames that operators receive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` without columns that start with an underscore: operators name their own columns so."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("_")])
