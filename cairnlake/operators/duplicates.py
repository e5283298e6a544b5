"""Near-duplicate cleanup inside each source file (bag-of-words cosine)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.arrays import bag, bag_cosine, bag_norm
from cairnlake.functions.params import CLEANUP_MIN_GROUP, CLEANUP_THRESHOLD, first_rows
from cairnlake.functions.partitions import broadcast_few
from cairnlake.functions.text import is_blank, tokens, trim
from cairnlake.operators import pivots as pivot_rows
from cairnlake.session import cut_and_free, cut_lineage

# Fixed rules of the cleanup.
KEPT_COMPARED = 5
MIN_TEXT = 20
LARGE_GROUP = 20
ESTIMATED_SHARE = 0.4
LARGEST_GROUPS = 15
# Drawers of one source that share a copy of its pivot.
SALT_ROWS = 2048
# Drawers of one source that are walked in order: one of so many, within these bounds.
FRONT_SHARE = 64
FRONT_LEAST = 64
FRONT_MOST = 1000


def cleanup_scope(drawers: DataFrame, wing: str | None = None, source_pattern: str | None = None) -> DataFrame:
    """Exact wing and case-insensitive source substring filters; blank means no filter."""
    if wing and wing.strip():
        drawers = drawers.where(F.col("wing") == wing)
    if source_pattern and source_pattern.strip():
        drawers = drawers.where(F.contains(F.lower("source_file"), F.lit(source_pattern.lower())))
    return drawers


def source_groups(drawers: DataFrame, min_group: int = CLEANUP_MIN_GROUP) -> DataFrame:
    """Sources with at least ``min_group`` drawers."""
    return (
        drawers.where(~is_blank(F.col("source_file")))
        .groupBy("source_file")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_group)
    )


def largest_groups(groups: DataFrame, limit: int | None = LARGEST_GROUPS) -> DataFrame:
    """The ``limit`` largest groups, or all of them in order."""
    return first_rows(groups.orderBy(F.desc("n"), "source_file"), limit)


def cleanup_stats(drawers: DataFrame, min_group: int = CLEANUP_MIN_GROUP) -> DataFrame:
    """One row of totals; large groups are assumed to hold a fixed share of duplicates."""
    estimate = F.rint(F.col("n") * ESTIMATED_SHARE).cast("long")
    counts = drawers.groupBy("source_file").agg(F.count("*").alias("n"))
    grouped = (~is_blank(F.col("source_file"))) & (F.col("n") >= min_group)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_drawers"),
        F.count_if(grouped).alias("source_groups"),
        F.coalesce(F.sum(F.when(grouped, F.col("n"))), F.lit(0)).alias("drawers_in_groups"),
        F.coalesce(F.sum(F.when(grouped & (F.col("n") > LARGE_GROUP), estimate)), F.lit(0)).alias("estimated_duplicates"),
    )


def _with_bags(drawers: DataFrame) -> DataFrame:
    counted = drawers.select(
        "id",
        "source_file",
        F.length("text").alias("length"),
        F.length(trim(F.col("text"))).alias("trimmed"),
        bag(tokens(F.col("text"))).alias("bag"),
    )
    return counted.withColumn("norm", bag_norm(F.col("bag")))


def _first_per_source(candidates: DataFrame) -> DataFrame:
    """Longest candidate of each source, smallest id first.

    The aggregate runs over narrow rows and is combined before the shuffle; the bags
    of the winners are fetched by id afterwards.
    """
    order = F.struct((-F.col("length")).alias("rank"), "id")
    winners = candidates.groupBy("source_file").agg(F.min(order).alias("first")).select(F.col("first.id").alias("id"))
    return candidates.join(winners, "id").select("source_file", "n", F.struct("id", "bag", "norm").alias("pivot"))


def _compared(candidates: DataFrame, pivots: DataFrame, salt_rows: int) -> DataFrame:
    """Join each candidate with its source's pivot; a source gets one key per ``salt_rows`` of its ``n`` drawers."""
    salts = F.ceil(F.col("n") / salt_rows).cast("int")
    spread = pivots.select("source_file", "pivot", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    cosine = bag_cosine(F.col("bag"), F.col("norm"), F.col("pivot.bag"), F.col("pivot.norm"))
    return salted.join(spread, ["source_file", "salt"]).withColumn("similarity", cosine).drop("salt")


def pivot_similarity(drawers: DataFrame, min_group: int = CLEANUP_MIN_GROUP, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Cosine of every drawer with the longest usable drawer of its source."""
    members = _with_bags(drawers).join(source_groups(drawers, min_group), "source_file")
    usable = members.where(F.col("trimmed") >= MIN_TEXT)
    compared = _compared(usable, _first_per_source(usable), salt_rows)
    return compared.where(F.col("id") != F.col("pivot.id")).select(
        "source_file", "id", F.col("pivot.id").alias("pivot_id"), "similarity"
    )


def _front_limit() -> Column:
    share = F.ceil(F.col("n") / FRONT_SHARE).cast("int")
    return F.least(F.lit(FRONT_MOST), F.greatest(F.lit(FRONT_LEAST), share))


def _front(rows: DataFrame) -> DataFrame:
    """``(source_file, id)`` of the longest rows of each source, a share of it and at most ``FRONT_MOST``.

    Narrow rows are ranked, those of a source first in parts side by side: as many that a
    part has about as many rows as go on from all parts.
    """
    order = [F.desc("length"), F.asc("id")]
    parts = F.ceil(F.sqrt(F.col("n") / _front_limit()))
    ranked = rows.select("source_file", "id", "length", "n", F.pmod(F.xxhash64("id"), parts).alias("salt"))
    for keys in (["source_file", "salt"], ["source_file"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        ranked = ranked.where((F.col("rank") <= FRONT_MOST) & (F.col("rank") <= _front_limit()))
    return ranked.select("source_file", "id")


def _beside(rows: DataFrame, pivots: DataFrame | None, keys: list[str], kept: list[str]) -> DataFrame:
    """The ``kept`` columns and tokens of rows, ordered by ``keys``, behind the pivots of their keys."""
    columns = list(dict.fromkeys([*keys, "id", *kept]))
    both = rows.select(F.lit(False).alias("pivot"), *dict.fromkeys([*columns, "length", "text"]))
    if pivots is not None:
        both = both.unionByName(pivots.select(F.lit(True).alias("pivot"), "*"), allowMissingColumns=True)
    # Dealt by a hash of the keys: by the keys themselves the exchange is left out where both sides come dealt by
    # them, though adaptive execution joins the partitions of each side in its own way.
    ordered = both.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, F.desc("pivot"), F.desc("length"), "id")
    return ordered.select("pivot", *columns, tokens(F.col("text")).alias("tokens"))


def _survivors(rows: DataFrame, pivots: DataFrame, threshold: float, salt_rows: int, kept: list[str]) -> DataFrame:
    """``kept`` columns of the rows that are no pivot of their source and close to none.

    Texts are dealt by source and one salt per ``salt_rows`` of its ``n`` drawers.
    """
    keys, salts = ["source_file", "salt"], F.ceil(F.col("n") / salt_rows).cast("int")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    spread = pivots.select("source_file", "id", "text", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    laid = _beside(salted, spread, keys, kept)
    types = dict(laid.dtypes)
    return laid.mapInArrow(pivot_rows.survivors(threshold, keys, kept), ", ".join(f"{name} {types[name]}" for name in kept))


def _rounds(drawers: DataFrame, groups: DataFrame, threshold: float, salt_rows: int, compared: int) -> DataFrame:
    """``(source_file, id)`` of what is kept, round by round over all rows that are left.

    Every row with the id of a pivot is a pivot, and a row stays once for each pivot of a
    round that is not close to it, so rows of such sources multiply.
    """
    members = cut_lineage(_with_bags(drawers).join(groups, "source_file"))
    remaining = members.where(F.col("trimmed") >= MIN_TEXT).select("id", "source_file", "n", "length", "bag", "norm")
    pivots_found: list[DataFrame] = []
    for _ in range(compared):
        if remaining.isEmpty():
            break
        pivots = _first_per_source(remaining)
        paired = _compared(remaining, pivots, salt_rows)
        pivots_found.append(pivots.select("source_file", F.col("pivot.id").alias("id")))
        remaining = cut_lineage(
            paired.where((F.col("id") != F.col("pivot.id")) & (F.col("similarity") < threshold)).drop("pivot", "similarity")
        )
    return reduce(DataFrame.unionByName, pivots_found, remaining.select("source_file", "id"))


def greedy_cleanup(
    drawers: DataFrame,
    threshold: float = CLEANUP_THRESHOLD,
    min_group: int = CLEANUP_MIN_GROUP,
    salt_rows: int = SALT_ROWS,
    compared: int = KEPT_COMPARED,
) -> DataFrame:
    """Decision per drawer of every large enough source: ``(source_file, id, kept)``.

    The rule walks a source from its longest text and drops a drawer that is too short
    or close to one of the first five kept. Only those five pivots ever matter, and a
    drawer that is kept before the fifth pivot *is* a pivot. So only the front of a source
    is walked in order; where it ends before the fifth pivot, the next front is taken of
    the drawers that no pivot so far is close to, and so begins with a pivot. One pass then
    lays all texts beside the pivots of their source. Tokens are made where they are
    compared; no bag is stored or shuffled.

    An id stands for all rows that bear it. Sources where an id is null, lies in another
    source too, or where a pivot's id is on several rows, are decided by ``_rounds``.
    """
    groups = broadcast_few(source_groups(drawers, min_group))
    members = drawers.select("id", "source_file").join(groups.select("source_file"), "source_file")
    usable = drawers.where(F.length(trim(F.col("text"))) >= MIN_TEXT).select("id", "source_file", "text", F.length("text").alias("length"))
    across = F.min("source_file") != F.max("source_file")
    repeated = broadcast_few(
        members.groupBy("id").agg(F.count("*").alias("rows"), across.alias("across")).where((F.col("rows") > 1) | F.col("id").isNull())
    )
    linked = repeated.where(F.col("across") | F.col("id").isNull()).select(F.col("id").alias("_id"))
    tangled = cut_lineage(members.join(linked, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("source_file").distinct())
    own = repeated.select("id", F.lit(False).alias("own"))
    id_type = dict(members.dtypes)["id"]

    chosen = broadcast_few(groups.join(tangled, "source_file", "left_anti"))
    rows, pivots, known = usable.join(chosen, "source_file"), None, None
    for _ in range(compared):
        front = usable.join(chosen, "source_file").join(broadcast_few(_front(rows)), ["source_file", "id"], "left_semi")
        front = front.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(True))).withColumn("limit", _front_limit())
        laid = _beside(front, known, ["source_file"], ["text", "limit", "own"])
        walked = cut_and_free(laid.mapInArrow(pivot_rows.walk(threshold, compared), f"source_file string, id {id_type}, text string, mark int"))
        found = walked.where(F.col("mark") == pivot_rows.PIVOT).drop("mark").join(groups, "source_file")
        pivots = found if pivots is None else pivots.unionByName(found)
        tangled = tangled.unionByName(walked.where(F.col("mark") == pivot_rows.TANGLED).select("source_file"))
        more = walked.where(F.col("mark") == pivot_rows.MORE).select("source_file")
        if more.isEmpty():
            break
        chosen = broadcast_few(groups.join(more, "source_file", "left_semi"))
        ahead = pivots.join(more, "source_file", "left_semi")
        known = ahead.select("source_file", "id", "text")
        rows = cut_and_free(_survivors(usable.join(chosen, "source_file"), ahead, threshold, salt_rows, ["source_file", "id", "n", "length"]))

    texts = usable.join(broadcast_few(groups.join(tangled, "source_file", "left_anti")), "source_file")
    if pivots is None:
        kept = texts.select("source_file", "id")
    else:
        pivots = pivots.join(tangled, "source_file", "left_anti")
        stay = cut_and_free(_survivors(texts, pivots, threshold, salt_rows, ["source_file", "id"]))
        kept = stay.unionByName(pivots.select("source_file", "id"))
    if not tangled.isEmpty():
        rest = drawers.join(broadcast_few(tangled), "source_file", "left_semi")
        kept = kept.unionByName(_rounds(rest, groups, threshold, salt_rows, compared))
    return members.select("source_file", "id").join(
        kept.select("id", F.lit(True).alias("hit")), "id", "left"
    ).select("source_file", "id", F.coalesce("hit", F.lit(False)).alias("kept"))


def cleanup_result(decisions: DataFrame) -> DataFrame:
    """Kept and deleted counts per source."""
    return decisions.groupBy("source_file").agg(
        F.count("*").alias("n"),
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("deleted"),
    )
