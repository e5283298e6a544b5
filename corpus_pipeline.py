"""The corpus pipeline: documents pass one stage after another, each written as Parquet.

Quality classifier, line dedup, near-duplicate removal and source mixing keep the columns
of ``documents``; the last stage encodes what is left. Each stage works on all that the
stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import bpe, lines, mixing, near_texts, quality
from cairnlake.llm.queries import VOCABULARY, table
from cairnlake.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where(quality.accepted(F.col("_score"))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return lines.dedup_lines(docs.select(*COLUMNS)).select(
        "doc_id", F.col("_kept").alias("text"), "lang", "source", F.length("_kept").cast("long").alias("n_chars")
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates, and all others."""
    return near_texts.mark_near_duplicates(docs.select(*COLUMNS)).where("_kept").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs.select(*COLUMNS))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed as little-endian unsigned 32-bit integers."""
    return bpe.encode(docs.select(*COLUMNS), VOCABULARY).select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.col("_n_tokens").alias("n_tokens"),
        F.col("_ids").alias("token_ids"),
        F.sha2(F.col("_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_encode", bpe_encode),
]

#: Classifier, near duplicates and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written to the shared folder and reread."""
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
