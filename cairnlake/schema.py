"""Table schemas of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

DRAWERS = "drawers"
COMPRESSED = "compressed"

DRAWER_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("wing", T.StringType(), False),
        T.StructField("room", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("source_mtime", T.LongType()),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("added_by", T.StringType(), False),
        T.StructField("filed_at", T.StringType()),
        T.StructField("embedding_signature", T.StringType()),
        T.StructField("ingest_mode", T.StringType()),
        T.StructField("extract_mode", T.StringType()),
        T.StructField("hall", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("emotional_weight", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("compression_ratio", T.DoubleType()),
        T.StructField("original_tokens", T.IntegerType()),
        T.StructField("compressed_tokens", T.IntegerType()),
    ]
)

ENTITY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.StringType()),
    ]
)

TRIPLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("subject", T.StringType(), False),
        T.StructField("predicate", T.StringType(), False),
        T.StructField("object", T.StringType(), False),
        T.StructField("valid_from", T.StringType()),
        T.StructField("valid_to", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source_closet", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("extracted_at", T.StringType()),
    ]
)

MESSAGE_SCHEMA = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
)
