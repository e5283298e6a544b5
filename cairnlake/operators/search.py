"""Lexical search and the duplicate check (token containment)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.arrays import containment
from cairnlake.functions.params import DUPLICATE_THRESHOLD, SEARCH_LIMIT, clamp_positive, clamp_threshold, first_rows
from cairnlake.functions.partitions import explode_rows
from cairnlake.functions.text import basename, ellipsis, half_even, one_line, token_set, tokens, trim
from cairnlake.operators.postings import TextIndex, best_matches, search_index

DUPLICATE_MATCHES = 5


def get_drawers(drawers: DataFrame, wing: str | None = None, room: str | None = None) -> DataFrame:
    """Filtered scan; only None means "no filter"."""
    if wing is not None:
        drawers = drawers.where(F.col("wing") == wing)
    if room is not None:
        drawers = drawers.where(F.col("room") == room)
    return drawers


def query_tokens(query: str) -> Column:
    """Distinct tokens of a literal query, folded to a constant by the optimizer."""
    return token_set(F.lit(query))


def lexical_search(
    drawers: DataFrame,
    query: str,
    limit: int = SEARCH_LIMIT[0],
    wing: str | None = None,
    room: str | None = None,
) -> DataFrame:
    """Best drawers by the share of query tokens they contain; ties by source, then id.

    A query without tokens matches every drawer with similarity zero.
    """
    wanted = query_tokens(query)
    scored = get_drawers(drawers, wing, room).withColumn("similarity", containment(wanted, tokens(F.col("text"))))
    # The best rows come first, so dropping the misses after the limit gives the same
    # result and the score is computed once per row.
    best = scored.orderBy(F.desc("similarity"), "source_file", "id").limit(limit)
    return best.where((F.col("similarity") > 0) | (F.size(wanted) == 0))


def search_memories(
    drawers: DataFrame,
    query: str,
    limit: int | None = None,
    wing: str | None = None,
    room: str | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """Search service: clamped limit, source base name, similarity rounded to three places.

    With an ``index`` the best drawers come from its postings, and only their texts are read.
    """
    most = clamp_positive(limit, SEARCH_LIMIT)
    if index is None:
        hits = lexical_search(drawers, query, most, wing, room)
    else:
        found = search_index(index, query, most, wing, room).select("id", "similarity")
        hits = drawers.join(found, "id").orderBy(F.desc("similarity"), "source_file", "id").limit(most)
    return hits.select(
        "id",
        "text",
        "wing",
        "room",
        basename(F.col("source_file")).alias("source_file"),
        half_even(F.col("similarity"), 3).alias("similarity"),
    )


def render_search(hits: DataFrame, query: str) -> DataFrame:
    """Numbered text layout of a result list (at most the search limit of rows) as one row."""
    order = Window.orderBy(F.desc("similarity"), "source_file", "id")
    body = F.concat(
        F.format_string("  [%d] %s/%s (sim=%s)\n", "position", "wing", "room", "similarity"),
        F.lit("      "),
        ellipsis(one_line(F.col("text")), 300, 297),
        F.when(trim(F.col("source_file")) != "", F.concat(F.lit("\n      src: "), F.col("source_file"))).otherwise(""),
    )
    numbered = hits.withColumn("position", F.row_number().over(order))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("position", body.alias("body")))), lambda e: e["body"])
    heading = f'## L3 - SEARCH RESULTS for "{query}"\n'
    return numbered.agg(entries.alias("entries")).select(
        F.when(F.size("entries") == 0, "No results found.")
        .otherwise(F.concat(F.lit(heading), F.array_join("entries", "\n")))
        .alias("rendered")
    )


def check_duplicate(
    drawers: DataFrame, content: str, threshold: float = DUPLICATE_THRESHOLD, limit: int | None = DUPLICATE_MATCHES
) -> DataFrame:
    """The ``limit`` best stored drawers that contain at least ``threshold`` of the tokens of ``content``."""
    wanted = query_tokens(content)
    scored = drawers.withColumn("score", containment(wanted, tokens(F.col("text"))))
    return (
        first_rows(scored.orderBy(F.desc("score"), "id"), limit)
        .where(F.col("score") >= clamp_threshold(threshold))
        .select("id", "wing", "room", half_even(F.col("score"), 3).alias("similarity"), ellipsis(F.col("text"), 200, 200).alias("content"))
    )


def containment_join(
    queries: DataFrame, drawers: DataFrame, threshold: float = DUPLICATE_THRESHOLD, salts: int = 16
) -> DataFrame:
    """All ``(query_id, id, score)`` with containment of the query in the drawer at or above ``threshold``.

    ``queries`` has ``(query_id, query)`` and ``drawers`` ``(id, text)``. A drawer that
    misses at most ``n - ceil(t * n)`` of a query's ``n`` tokens must hold one of any
    ``n - ceil(t * n) + 1`` of them, so only that many of the rarest tokens are looked up
    in the inverted index; the full score is computed on the surviving pairs only.
    Postings of frequent tokens are spread over ``salts`` keys. ``threshold`` must be
    above zero: at zero every pair qualifies.
    """
    if threshold <= 0:
        raise ValueError("containment_join needs a positive threshold")
    wanted = queries.select("query_id", token_set(F.col("query")).alias("query_tokens"))
    stored = drawers.select("id", token_set(F.col("text")).alias("tokens"))
    postings = explode_rows(stored, F.col("tokens"), "token", "id")
    lookups = explode_rows(wanted, F.col("query_tokens"), "token", "query_id", F.size("query_tokens").alias("n"))

    frequency = (
        postings.join(lookups.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("df"))
    )
    # A token absent from the store still occupies a place among the rarest.
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "token")
    required = F.ceil(F.col("n") * threshold - 1e-9)
    probes = (
        lookups.join(frequency, "token", "left")
        .withColumn("place", F.row_number().over(rarest))
        .where((F.col("place") <= F.col("n") - required + 1) & F.col("df").isNotNull())
        .select("query_id", "token", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    pairs = probes.join(salted, ["token", "salt"]).select("query_id", "id").distinct()
    # Only drawers with a candidate query are read and tokenised for the full score.
    candidates = drawers.select("id", "text").join(pairs.select("id").distinct(), "id", "left_semi")
    verified = candidates.select("id", tokens(F.col("text")).alias("tokens"))
    score = containment(F.col("query_tokens"), F.col("tokens"))
    return (
        pairs.join(wanted, "query_id")
        .join(verified, "id")
        .select("query_id", "id", score.alias("score"))
        .where(F.col("score") >= threshold)
    )


def check_duplicate_batch(
    queries: DataFrame, drawers: DataFrame, threshold: float = DUPLICATE_THRESHOLD, index: TextIndex | None = None
) -> DataFrame:
    """Best five stored matches of every query, as the single check reports them.

    Matches come from ``index``, or from one made of ``drawers`` for this call; at most
    five rows of a query meet the drawers for the texts that are shown.
    """
    matches = best_matches(queries, index or TextIndex.of(drawers), clamp_threshold(threshold), DUPLICATE_MATCHES)
    return matches.join(drawers, "id").select(
        "query_id",
        "place",
        "id",
        "wing",
        "room",
        half_even(F.col("score"), 3).alias("similarity"),
        ellipsis(F.col("text"), 200, 200).alias("content"),
    )
