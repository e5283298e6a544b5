"""Map the analytics tables of a folder onto the engine schema.

Each function plans a scan with only the columns it needs, so projections and
filters of a query still reach the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import text as tx
from cairnlake.functions.partitions import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose text columns are about to be processed."""
    return spread(table(spark, folder, name))


def drawers(spark: SparkSession, folder: str, labelled: bool = False, heavy: bool = False) -> DataFrame:
    """``documents`` as drawers.

    ``labelled`` adds the columns that need the ``labels`` join; ``heavy`` spreads a small
    table over all cores because its text will be processed.
    """
    slot = F.col("doc_id") % 13
    room = (
        F.when(slot == 0, F.lit("general"))
        .when(slot < 9, F.concat_ws("_", F.lit("room"), F.col("lang"), slot.cast("string")))
        .otherwise(F.concat(F.lit("room_shared_"), slot.cast("string")))
    )
    docs = (
        (texts if heavy else table)(spark, folder, "documents")
        .withColumn("room", room)
        .withColumn("date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd"))
        .select(
            F.concat_ws(
                "_",
                F.lit("drawer"),
                "lang",
                "room",
                F.substring(F.sha2(F.concat("source", F.col("doc_id").cast("string")), 256), 1, 24),
            ).alias("id"),
            "text",
            F.col("lang").alias("wing"),
            "room",
            F.col("source").alias("source_file"),
            F.lit(0).alias("chunk_index"),
            "date",
            F.concat("date", F.lit("T00:00:00")).alias("filed_at"),
            "doc_id",
        )
    )
    if not labelled:
        return docs
    labels = table(spark, folder, "labels")
    hall = (
        F.when(F.col("toxic") == 1, "hall_toxic")
        .when(F.col("quality") == 1, "hall_quality")
        .when(F.col("quality") == 0, "hall_noise")
    )
    return docs.join(labels, "doc_id", "left").select(
        docs["*"],
        hall.alias("hall"),
        (F.col("quality") * 3.0 + F.col("toxic")).alias("importance"),
        F.lit(None).cast("double").alias("emotional_weight"),
        F.lit(None).cast("double").alias("weight"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` without system turns: ``(conv_id, turn, role, text)``."""
    return table(spark, folder, "conversations").where(F.col("role").isin("user", "assistant"))


def triples(spark: SparkSession, folder: str) -> DataFrame:
    """Facts derived from the business tables, named by display name."""
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    nothing = F.lit(None).cast("string")

    def fact(df: DataFrame, subject, predicate: str, obj, start=nothing, end=nothing) -> DataFrame:
        return df.select(
            subject.alias("subject_name"),
            F.lit(predicate).alias("predicate"),
            obj.alias("object_name"),
            start.alias("valid_from"),
            end.alias("valid_to"),
        )

    def day(column) -> F.Column:
        return F.date_format(column, "yyyy-MM-dd")

    located = fact(
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_name"), "located_in", F.col("n_name")
    ).unionByName(
        fact(
            table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")),
            F.col("s_name"),
            "located_in",
            F.col("n_name"),
        )
    )
    part_of = fact(
        nation.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")),
        F.col("n_name"),
        "part_of",
        F.col("r_name"),
    )
    placed = fact(
        table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")),
        F.col("c_name"),
        "placed",
        F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")),
        day(F.col("o_orderdate")),
        F.when(F.col("o_orderstatus") != "O", day(F.date_add(F.col("o_orderdate"), 90))),
    )
    events = (
        table(spark, folder, "events")
        .select("user_id", "event_type", day(F.col("ts")).alias("d"))
        .distinct()
    )
    did = fact(
        events,
        F.concat(F.lit("User#"), F.col("user_id").cast("string")),
        "did",
        F.col("event_type"),
        F.col("d"),
        F.when(F.col("event_type") == "error", F.col("d")),
    )
    named = located.unionByName(part_of).unionByName(placed).unionByName(did)
    return named.select(
        tx.entity_id(F.col("subject_name")).alias("subject"),
        "predicate",
        tx.entity_id(F.col("object_name")).alias("object"),
        "valid_from",
        "valid_to",
        F.lit(1.0).alias("confidence"),
        "subject_name",
        "object_name",
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Named nodes of the facts, one row per normalised id."""

    def named(df: DataFrame, name, kind: str) -> DataFrame:
        return df.select(name.alias("name"), F.lit(kind).alias("type"))

    names = (
        named(table(spark, folder, "customer"), F.col("c_name"), "customer")
        .unionByName(named(table(spark, folder, "supplier"), F.col("s_name"), "supplier"))
        .unionByName(named(table(spark, folder, "nation"), F.col("n_name"), "nation"))
        .unionByName(named(table(spark, folder, "region"), F.col("r_name"), "region"))
        .unionByName(
            named(
                table(spark, folder, "orders"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), "order"
            )
        )
        .unionByName(
            named(
                table(spark, folder, "events").select("user_id").distinct(),
                F.concat(F.lit("User#"), F.col("user_id").cast("string")),
                "user",
            )
        )
        .unionByName(named(table(spark, folder, "events").select("event_type").distinct(), F.col("event_type"), "event"))
    )
    return names.select(tx.entity_id(F.col("name")).alias("id"), "name", "type")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as ``(id, wing, embedding)``."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("wing"), "embedding"
    )
