"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target, and the ratio of the two is the
rate at which its documents repeat: a document is emitted ``floor(rate)`` times plus once
more with a probability equal to the fraction, decided by a hash of its id.

Defined results: a null or empty text has size 0 and takes nothing; null sources form one
source, last in order; a source without any word has target 0; rows with one id share
their decision; other columns pass through,
but for those whose name starts with an underscore; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.frames import plain

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    ``share`` is the mix as a fraction of all sizes, ``most`` the factor at which a target
    stops; what a stopped target leaves goes to the others by weight. With the sources in
    order of the level at which they stop, one running sum finds the level of the rest.
    Only one row per source reaches the ordered steps.
    """
    up, down = share
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(int(w)) for w in weights])

    def wide(value: Column) -> Column:
        return value.cast("decimal(30,0)")

    def product(a: Column, b: Column) -> Column:
        return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")

    levels = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", F.element_at(cycle, (F.row_number().over(everything) - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_all", F.sum("source_size").over(whole) * up)
        .withColumn("_weights", F.sum("_weight").over(whole))
        .withColumn("_left", F.col("_all") - down * F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights_left", F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn(
            "_stopped",
            product(down * F.col("_cap"), F.col("_weights_left")) <= product(F.col("_weight"), F.col("_left")),
        )
    )
    rest = levels.withColumn(
        "_rest", F.col("_all") - down * F.coalesce(F.sum(F.when(F.col("_stopped"), F.col("_cap"))).over(whole), F.lit(0))
    ).withColumn("_open", F.sum(F.when(~F.col("_stopped"), F.col("_weight"))).over(whole))
    target = F.when(F.col("_stopped"), F.col("_cap").cast("double")).otherwise(
        F.col("_weight").cast("double") * F.col("_rest").cast("double") / (down * F.col("_open")).cast("double")
    )
    return rest.select("source", "source_size", target.alias("target"))


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """Number in [0, 1) from the id, or from the text where the id is null."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def plan_mix(docs: DataFrame, seed: int = 7, **targets) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and the number of ``_copies`` the mix takes."""
    docs = plain(docs)
    sized = docs.withColumn("_size", word_count(F.col("text"))).withColumn(
        "_chance", chance(F.col("doc_id"), F.col("text"), seed)
    )
    narrow = docs.select("source", word_count(F.col("text")).alias("size"))
    aims = source_targets(narrow, **targets).select(
        F.col("source").alias("_source"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
    )
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("_chance") < rate - F.floor(rate), 1).otherwise(0)
    return (
        sized.join(aims, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_copies", copies.cast("int"))
        .drop("_source", "_chance")
    )


def mix(docs: DataFrame, seed: int = 7, **targets) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: each document as often as it is taken."""
    docs = plain(docs)
    planned = plan_mix(docs, seed, **targets).where(F.col("_copies") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return planned.select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias("_copy")).drop("_copy")
