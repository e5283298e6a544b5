"""Inverted index over drawers: lookups, search and duplicate checks that tokenise no stored text.

``docs`` holds each drawer's names and distinct tokens, ``postings`` one row per token and
drawer, sorted by token where it is stored, so that a lookup reads the row groups of its
tokens only. A stored index is kept up to date by ``add`` and ``delete``: both tables are
versioned, a change writes rows and tombstones in proportion to itself, and version ``n``
of the one belongs to version ``n`` of the other.

Containment counts matching tokens, so a list of a token adds one to a score at most. That
is the bound by which a search leaves lists of common tokens unread for new drawers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.functions.arrays import containment
from cairnlake.functions.params import SEARCH_LIMIT
from cairnlake.functions.partitions import broadcast_few, explode_rows
from cairnlake.functions.text import token_set
from cairnlake.session import cut_lineage
from cairnlake.sources.versions import VersionedTable

NAMES = ["id", "wing", "room", "source_file"]
DOCS = T.StructType([T.StructField(name, T.StringType()) for name in NAMES]).add("tokens", T.ArrayType(T.StringType()))
POSTINGS = T.StructType([T.StructField(name, T.StringType()) for name in ("token", "id")])
#: Drawers of a token per part, and parts at most.
PART_ROWS, MOST_PARTS = 4096, 64
#: Parts of the first of two rankings per query.
SALTS = 16


@dataclass
class TextIndex:
    """Frames of an index: ``docs`` ``(id, wing, room, source_file, tokens)`` and ``postings`` ``(token, id)``."""

    docs: DataFrame
    postings: DataFrame

    @staticmethod
    def of(drawers: DataFrame) -> TextIndex:
        """Index of a frame for the plans of one query; every text is tokenised once."""
        docs = cut_lineage(_tokenised(drawers))
        return TextIndex(docs, _posted(docs))


def _tokenised(drawers: DataFrame) -> DataFrame:
    names = [(F.col(n) if n in drawers.columns else F.lit(None).cast("string")).alias(n) for n in NAMES]
    return drawers.select(*names, token_set(F.col("text")).alias("tokens"))


def _posted(docs: DataFrame) -> DataFrame:
    return explode_rows(docs, F.col("tokens"), "token", "id").select("token", "id")


class StoredIndex:
    """An index in a folder. The docs are its truth: postings of a version they do not have are dropped."""

    def __init__(self, spark: SparkSession, folder: str):
        self.docs = VersionedTable(spark, f"{folder}/docs", DOCS, ["id"])
        self.postings = VersionedTable(spark, f"{folder}/postings", POSTINGS, ["id"], ["token", "id"])

    def open(self) -> TextIndex:
        version = self.docs.manifest().version
        return TextIndex(self.docs.read(version), self.postings.read(version))

    def _change(self, docs: DataFrame | None, gone: DataFrame) -> None:
        self.postings.drop_after(self.docs.manifest().version)
        self.postings.commit(None if docs is None else _posted(docs), gone=gone)
        self.docs.commit(docs, gone=gone)

    def add(self, drawers: DataFrame) -> None:
        """Index drawers; a drawer whose id is known is indexed anew."""
        docs = cut_lineage(_tokenised(drawers))
        self._change(docs, docs.select("id"))

    def delete(self, ids: DataFrame) -> None:
        self._change(None, ids.select("id"))

    def rebuild(self, drawers: DataFrame) -> None:
        """Index a whole table anew."""
        docs = cut_lineage(_tokenised(drawers))
        self.postings.drop_after(self.docs.manifest().version)
        self.postings.replace(_posted(docs))
        self.docs.replace(docs)

    def compact(self) -> None:
        self.postings.drop_after(self.docs.manifest().version)
        self.postings.compact()
        self.docs.compact()


def frequencies(index: TextIndex, tokens: DataFrame) -> DataFrame:
    """``(token, df)`` of the asked tokens that some drawer has."""
    return index.postings.join(tokens, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))


def _parts(df: Column) -> Column:
    return F.least(F.ceil(df / PART_ROWS), F.lit(MOST_PARTS)).cast("int")


def _candidates(wanted: DataFrame, index: TextIndex, threshold: float) -> DataFrame:
    """Distinct ``(query_id, id)`` that share one of a query's rarest tokens.

    A drawer that holds ``required`` of ``n`` tokens holds one of any ``n - required + 1``.
    Only lists of many drawers are cut into parts, and only their probes are repeated.
    """
    lookups = explode_rows(wanted, F.col("query_tokens"), "token", "query_id", F.size("query_tokens").alias("n"))
    # The lists are long and the asked tokens often few: then rows of other tokens stay in their task.
    known = cut_lineage(frequencies(index, broadcast_few(lookups.select("token").distinct())))
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "token")
    required = F.ceil(F.col("n") * threshold - 1e-9)
    probes = (
        lookups.join(known, "token", "left")
        .withColumn("_place", F.row_number().over(rarest))
        .where((F.col("_place") <= F.col("n") - required + 1) & F.col("df").isNotNull())
        .select("query_id", "token", _parts(F.col("df")).alias("_parts"))
    )
    needed = broadcast_few(probes.select("token", "_parts").distinct())
    lists = index.postings.join(needed, "token").select("token", "id", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_part"))
    asked = probes.select("query_id", "token", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return asked.join(lists, ["token", "_part"]).select("query_id", "id").distinct()


def matching_pairs(queries: DataFrame, index: TextIndex, threshold: float) -> DataFrame:
    """``(query_id, id, score)`` of all pairs with containment at or above ``threshold``, which must be positive."""
    if threshold <= 0:
        raise ValueError("a positive threshold is needed: at zero every pair qualifies")
    wanted = cut_lineage(queries.select("query_id", token_set(F.col("query")).alias("query_tokens")))
    pairs = _candidates(wanted, index, threshold)
    held = index.docs.select("id", "tokens").join(pairs, "id")
    score = containment(F.col("query_tokens"), F.col("tokens"))
    return held.join(wanted, "query_id").select("query_id", "id", score.alias("score")).where(F.col("score") >= threshold)


def best_matches(queries: DataFrame, index: TextIndex, threshold: float, limit: int) -> DataFrame:
    """``(query_id, id, score, place)``: at most ``limit`` matches of every query, ties by id.

    Ranked per part of the drawers first, so no task ranks all matches of a common query.
    """
    best = [F.desc("score"), F.col("id")]
    salted = matching_pairs(queries, index, threshold).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*best)))
    return (
        some.where(F.col("place") <= limit)
        .drop("_salt")
        .withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
        .where(F.col("place") <= limit)
    )


def search_index(
    index: TextIndex, query: str, limit: int = SEARCH_LIMIT[0], wing: str | None = None, room: str | None = None
) -> DataFrame:
    """``(id, wing, room, source_file, similarity)`` as the lexical search ranks them, from postings.

    Lists are read from the rarest token on. The kth best count over half of them proves
    how many of the commonest lists cannot bring a new drawer among the best; of those,
    only rows of drawers already found are used.
    """
    spark = index.docs.sparkSession
    tokens = sorted(spark.range(1).select(token_set(F.lit(query)).alias("t")).first()["t"])
    docs = index.docs.select(*NAMES)
    for name, value in (("wing", wing), ("room", room)):
        if value is not None:
            docs = docs.where(F.col(name) == value)
    order = [F.desc("similarity"), F.col("source_file"), F.col("id")]
    if not tokens:
        return docs.withColumn("similarity", F.lit(0.0)).orderBy(*order).limit(limit)
    df = {row["token"]: row["df"] for row in frequencies(index, spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    lists = sorted((t for t in tokens if t in df), key=lambda t: (df[t], t))

    def counted(chosen: list[str]) -> DataFrame:
        rows = index.postings.where(F.col("token").isin(chosen)).groupBy("id").agg(F.count("*").alias("_n"))
        return rows.join(docs.select("id"), "id", "left_semi") if wing is not None or room is not None else rows

    half = lists[: -(-len(lists) // 2)]
    sure = counted(half).orderBy(F.desc("_n")).limit(limit).agg(F.count("*").alias("rows"), F.min("_n").alias("least")).first()
    spared = min(len(lists) - len(half), sure["least"] - 1) if sure["rows"] == limit else 0
    read = lists[: len(lists) - spared]
    found = counted(read)
    if spared:
        more = index.postings.where(F.col("token").isin(lists[-spared:])).join(found.select("id"), "id", "left_semi")
        found = found.unionByName(more.groupBy("id").agg(F.count("*").alias("_n"))).groupBy("id").agg(F.sum("_n").alias("_n"))
    scored = found.join(docs, "id").withColumn("similarity", F.col("_n") / F.lit(float(len(tokens))))
    return scored.select(*NAMES, "similarity").orderBy(*order).limit(limit)


def accepted_in_order(requests: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Judge a batch against itself: ``(accepted ids, (id, accepted id) matches)``.

    ``requests`` has ``(id, ord, text, blocked)``; a request is accepted unless it is
    blocked or an accepted one before it (smaller ``ord``, then id) contains enough of its
    tokens. Requests of equal token sets are one candidate, the first of them: the others
    match whatever it matches, or itself. Candidates are decided in rounds: who waits for
    no undecided one is decided, so a round settles every request whose predecessors are.
    """
    held = cut_lineage(requests.withColumn("tokens", F.array_sort(token_set(F.col("text")))).drop("text"))
    first = F.struct("ord", "id")
    sets = (
        held.where(F.size("tokens") > 0)
        .groupBy("tokens")
        .agg(F.min(first).alias("_first"), F.max("blocked").alias("blocked"))
        .select(F.col("_first.id").alias("id"), F.col("_first").alias("_place"), "tokens", "blocked")
    )
    sets = cut_lineage(sets)
    index = TextIndex(sets.select("id", "tokens"), _posted(sets))
    wanted = sets.select(F.col("id").alias("query_id"), F.array_join("tokens", " ").alias("query"))
    pairs = cut_lineage(
        matching_pairs(wanted, index, threshold)
        .where("query_id <> id")
        .join(sets.select(F.col("id").alias("query_id"), F.col("_place").alias("_late")), "query_id")
        .join(sets.select("id", F.col("_place").alias("_early")), "id")
        .select("query_id", "id", (F.col("_early") < F.col("_late")).alias("_before"))
    )
    before = pairs.where("_before").select("query_id", "id")
    state = cut_lineage(sets.select("id", F.when(F.col("blocked"), F.lit(False)).alias("_in")))
    while not state.where("_in IS NULL").isEmpty():
        met = before.join(state, "id").groupBy("query_id").agg(
            F.coalesce(F.max("_in"), F.lit(False)).alias("_hit"), F.count_if(F.col("_in").isNull()).alias("_open")
        )
        decided = F.when(F.col("_in").isNotNull(), F.col("_in")).when(F.col("_hit"), False).when(F.coalesce("_open", F.lit(0)) == 0, True)
        state = cut_lineage(
            state.join(met, state["id"] == met["query_id"], "left").select("id", decided.alias("_in"))
        )
    accepted = state.where("_in").select("id")
    bare = held.where((F.size("tokens") == 0) & ~F.col("blocked")).select("id")
    # A request matches the accepted ones before it that its set matches, or that opened its set.
    member = held.join(sets.select("tokens", F.col("id").alias("query_id")), "tokens").select(F.col("id").alias("_member"), F.struct("ord", "id").alias("_own"), "query_id")
    linked = pairs.select("query_id", "id").unionByName(sets.select(F.col("id").alias("query_id"), "id"))
    places = sets.select("id", F.col("_place").alias("_at"))
    matches = (
        linked.join(accepted, "id").join(places, "id").join(member, "query_id").where(F.col("_at") < F.col("_own"))
    ).select(F.col("_member").alias("id"), F.col("id").alias("accepted_id"))
    return accepted.unionByName(bare), matches
