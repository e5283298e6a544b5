"""Registered queries of the training-data operators: whole tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import (
    bpe,
    digests,
    divergence,
    lines,
    mixing,
    near_texts,
    near_vectors,
    personal,
    quality,
    ranking,
    secrets,
    suffixes,
    windows,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = F.col("_spans")
    base = F.filter(found, lambda s: s["kind"].isin(*secrets.KINDS))
    return secrets.find_secrets(docs, secrets.learn_formats(docs)).select(
        "doc_id",
        *[secrets.count_of(found, kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(personal.joined(base), 256).alias("base_sha256"),
        personal.joined(found).alias("spans"),
    )


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.dedup_repeats(docs).select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"),
        F.size("_removed").cast("long").alias("n_spans"),
        F.sha2(F.col("_kept"), 256).alias("kept_sha256"),
    )


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = F.col("_spans")
    return personal.find_personal(docs).select(
        "doc_id",
        *[F.size(personal.of_kinds(found, kind)).cast("long").alias(f"n_{kind}") for kind in personal.BASE_KINDS],
        F.sha2(personal.joined(personal.of_kinds(found, *personal.BASE_KINDS)), 256).alias("base_sha256"),
        personal.joined(found).alias("spans"),
    )


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, VOCABULARY).select(
        "doc_id",
        F.col("_n_tokens").alias("n_tokens"),
        F.sha2(F.col("_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded"), 256).alias("decoded_sha256"),
    )


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", F.round("_score", 6).alias("score"), quality.accepted(F.col("_score")).alias("kept")
    )


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept"), 256).alias("kept_sha256"),
    )


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ordered = digests.with_next(digests.fingerprints(docs), ["text", "_print"])
    changed = ordered.withColumn("_edited", digests.edited(F.col("text"), F.col("_next_text"))).withColumn(
        "_edited_print", digests.fingerprint(F.col("_edited"))
    )
    return changed.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        F.col("_print").alias("fingerprint"),
        F.col("_edited_print").alias("edited_fingerprint"),
        digests.closeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        digests.closeness(F.col("_print"), F.col("_next__print")).alias("near_next"),
    )


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
    )


def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings"), cosine=0.98)


def op10_near_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    groups = near_texts.near_groups(docs).withColumnRenamed("doc_id", "_id")
    group = F.coalesce("group_id", "doc_id")
    return docs.select("doc_id").join(groups, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", group.alias("group_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept")
    )


def op11_word_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return windows.dedup_windows(docs, length=20).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.col("_kept"), 256).alias("kept_sha256"),
    )


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents").select("text", "lang", "source"), min_docs=3, top_terms=200)


def op13_lexical_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ranking.rank_documents(docs, table(spark, folder, "benchmark"), limit=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_personal_data": op3_personal_data,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_source_mix": op8_source_mix,
    "op9_near_vectors": op9_near_vectors,
    "op10_near_texts": op10_near_texts,
    "op11_word_windows": op11_word_windows,
    "op12_divergence": op12_divergence,
    "op13_lexical_ranking": op13_lexical_ranking,
}
