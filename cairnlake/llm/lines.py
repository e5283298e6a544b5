"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. A batch counts, per line key, the documents that hold it,
merge-anti-joins its keys with those that the runs have already settled (found in
``min_docs`` documents), and adds the rest as a sorted run of its own. ``fanout`` runs of
one level are compacted into one of the next, where counts of equal hashes add up. Lines
whose key the runs settle leave every document.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars``
stay; each row counts as one document, also when ids repeat or are null; other columns
pass through, but for those whose name starts with an underscore; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import let
from cairnlake.llm.frames import plain
from cairnlake.session import cut_lineage

BLANK = " \t\n\x0b\x0c\r"
HASHES = ["_h1", "_h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The trimmed line with A-Z lower-cased; a line of ASCII alone by ``lower``, which costs far less than ``translate``."""

    def key(trimmed: Column) -> Column:
        ascii_alone = F.octet_length(trimmed) == F.char_length(trimmed)
        return F.when(ascii_alone, F.lower(trimmed)).otherwise(
            F.translate(trimmed, string.ascii_uppercase, string.ascii_lowercase)
        )

    return let(F.btrim(line, F.lit(BLANK)), key)


def line_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the key of a line, NULL where the key is too short."""

    def judge(key: Column) -> Column:
        hashed = F.struct(F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2"))
        return F.when(F.length(key) >= min_chars, hashed)

    # Bound, because the key would be made anew for its length and for each half of the hash.
    return let(line_key(line), judge)


def hashes_of(text: Column, min_chars: int) -> Column:
    """Distinct line hashes of a text."""
    return F.array_compact(F.array_distinct(F.transform(lines_of(text), lambda line: line_hash(line, min_chars))))


class LineRuns:
    """Levels of sorted runs ``(_h1, _h2, _docs)``; every run is a reliable checkpoint."""

    def __init__(self, min_docs: int = 10, min_chars: int = 1, fanout: int = 2):
        self.min_docs, self.min_chars, self.fanout = min_docs, min_chars, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def settled(self) -> DataFrame:
        """Hashes that some run has found in ``min_docs`` documents."""
        return reduce(DataFrame.unionByName, self.runs()).where(F.col("_docs") >= self.min_docs).select(*HASHES).distinct()

    def add(self, docs: DataFrame) -> None:
        counted = (
            docs.select(F.explode(hashes_of(F.col("text"), self.min_chars)).alias("_h"))
            .select("_h.*")
            .groupBy(*HASHES)
            .agg(F.count("*").alias("_docs"))
        )
        if self.levels:
            counted = counted.join(self.settled().hint("merge"), HASHES, "left_anti")
        self._push(counted, 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(cut_lineage(run.sortWithinPartitions(*HASHES)))
        if len(self.levels[level]) == self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._push(merged, level + 1)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*HASHES).agg(F.sum("_docs").alias("_docs"))

    def frequent(self) -> DataFrame:
        """``(_h1, _h2)`` of every key in at least ``min_docs`` documents."""
        return self._merge(self.runs()).where(F.col("_docs") >= self.min_docs).select(*HASHES)


def batches_of(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` cut into ``batches`` parts by a hash of the id; together they hold every row."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    return [docs.where(part == n) for n in range(batches)]


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` with ``_kept`` (the text without frequent lines), ``_n_lines`` and ``_n_dropped``.

    The hashes of frequent lines come back to a document as one short list keyed by its
    id; a list may hold lines of another row with that id, which are frequent as well.
    """
    docs = plain(docs)
    runs = LineRuns(min_docs, min_chars, fanout)
    for part in batches_of(docs.select("doc_id", "text"), batches):
        runs.add(part)
    listed = (
        docs.select(F.xxhash64("doc_id").alias("_doc"), F.explode(hashes_of(F.col("text"), min_chars)).alias("_h"))
        .select("_doc", "_h.*")
        .join(runs.frequent(), HASHES, "left_semi")
        .groupBy("_doc")
        .agg(F.collect_set(F.struct(*HASHES)).alias("_bad"))
    )
    lines = lines_of(F.col("text"))
    stays = F.filter(
        lines, lambda line: ~F.coalesce(F.array_contains("_bad", line_hash(line, min_chars)), F.lit(False))
    )
    kept = F.when(F.col("_bad").isNull(), lines).otherwise(stays)
    return (
        docs.withColumn("_doc", F.xxhash64("doc_id"))
        .join(listed, "_doc", "left")
        .withColumn("_lines", kept)
        .withColumn("_kept", F.array_join("_lines", "\n"))
        .withColumn("_n_lines", F.size(lines).cast("long"))
        .withColumn("_n_dropped", F.col("_n_lines") - F.size("_lines"))
        .drop("_doc", "_bad", "_lines")
    )
