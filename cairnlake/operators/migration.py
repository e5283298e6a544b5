"""Drawers from a legacy store of key-value rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import is_blank
from cairnlake.schema import DRAWER_SCHEMA

# Fixed value: the key that carries the text.
DOCUMENT_KEY = "chroma:document"


def source_version(collection_columns: list[str], tables: list[str]) -> str:
    """Version of a legacy store by its schema."""
    if "schema_str" in collection_columns:
        return "1.x"
    return "0.6.x" if "embeddings_queue" in tables else "unknown"


def _typed(value: Column, kind: str) -> Column:
    """First non-null of the typed cells, as the wanted type; unparsable text is NULL."""
    if kind == "string":
        flag = F.when(value["bool_value"] != 0, "True").when(value["bool_value"] == 0, "False")
        return F.coalesce(value["string_value"], value["int_value"].cast("string"), value["float_value"].cast("string"), flag)
    number = F.coalesce(value["int_value"].cast("double"), value["float_value"])
    if kind == "double":
        text = value["string_value"]
        return F.when(text.isNotNull(), text.try_cast("double")).otherwise(number)
    # Text must be a whole number; a double is truncated.
    text = value["string_value"]
    parsed = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast(kind))
    return F.when(text.isNotNull(), parsed).otherwise(
        F.coalesce(value["int_value"].cast(kind), value["float_value"].try_cast(kind))
    )


def drawers_from_cells(embeddings: DataFrame, cells: DataFrame) -> DataFrame:
    """Pivot ``(id, key, string_value, int_value, float_value, bool_value)`` cells to drawers.

    One join and one aggregate build all columns; rows without text are dropped.
    """
    cell = F.struct("string_value", "int_value", "float_value", "bool_value")
    fields = [field for field in DRAWER_SCHEMA if field.name not in ("id", "text")]
    keyed = embeddings.join(cells, "id").where(F.col("key").isin([DOCUMENT_KEY, *[f.name for f in fields]]))
    wide = keyed.groupBy("embedding_id").agg(
        F.max(F.when(F.col("key") == DOCUMENT_KEY, F.col("string_value"))).alias("_text"),
        *[F.any_value(F.when(F.col("key") == f.name, cell), True).alias(f"_{f.name}") for f in fields],
    )
    columns = []
    for field in fields:
        value = _typed(F.col(f"_{field.name}"), field.dataType.simpleString())
        if not field.nullable:
            value = F.coalesce(value, F.lit("" if field.dataType.simpleString() == "string" else 0))
        columns.append(value.alias(field.name))
    return wide.where(~is_blank(F.col("_text"))).select(
        F.col("embedding_id").alias("id"), F.col("_text").alias("text"), *columns
    )
