"""Source divergence audit: how far the term counts of sources differ, exactly.

*Counts.* A task counts the terms of its texts per (lang, source) and hands on one row per
group and term, with the number of documents that hold it; Spark adds them up per term.

*Run-length columns.* The vocabulary of a lang is put in the order of its terms' counts
over all sources, so terms with equal counts stand together: they are one entry with a
multiplicity. Sorted entries are cut into blocks, and each source's column of a block is
run-length encoded, zeros included.

*Pairs.* For two sources the run boundaries of a block are intersected; on a piece of the
intersection both counts are constant, so its terms add ``f`` times the length of the
piece. Blocks (and tiles of sources, where a lang has many) spread over tasks; Spark adds
the pieces of a pair up.

All arithmetic is in integers: 64-bit where it is proven to suffice, Python's or
decimals beyond. No step gathers a lang: rows of one block or one term are the largest.

Defined results: null text, lang and source count as ''; a group without kept terms keeps
its pairs, all with the smoothed share of an empty count; a lang without kept terms has
pairs of value 0 and no terms; each row counts as one document, also when ids repeat;
no other column is read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.session import cut_lineage

#: Lower-cased byte of a term, or 0 where the byte stands in none.
TERMS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
SCALE = 1_000_000_000
#: Bytes of text that are counted at once, counts that a task holds, and rows that it hands on at once.
SLICE = 2 << 20
HELD = 400_000
ROWS = 50_000
#: Entries of one block of the ordered vocabulary.
BLOCK = 8192
#: Sources on the left side of one task's pairs.
TILE = 64

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_slice(texts: list[bytes], langs: list[str], sources: list[str]) -> pa.Table:
    """Occurrences and documents per (lang, source, term) of some texts, and one row without a term per group."""
    groups = {group: number for number, group in enumerate(dict.fromkeys(zip(langs, sources, strict=True)))}
    group = np.array([groups[key] for key in zip(langs, sources, strict=True)], dtype=np.int64)
    names = [pa.array(column, pa.string()) for column in zip(*groups, strict=True)]
    data = TERMS[np.frombuffer(b" ".join(texts), np.uint8)]
    inside = data > 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, stop = edges[::2], edges[1::2]
    ends = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(stop - start, out=ends[1:])
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]
    coded = pa.Array.from_buffers(pa.string(), len(start), buffers).dictionary_encode()
    size = max(1, len(coded.dictionary))
    doc = np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), start, side="right")
    held, times = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
    key = group[held // size] * size + held % size
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.diff(key[order], prepend=-1))
    n = np.add.reduceat(times[order], heads) if len(heads) else times
    found = key[order[heads]]
    which = np.concatenate([found // size, np.arange(len(groups))])
    empty = np.zeros(len(groups), dtype=np.int64)
    term = coded.dictionary.take(pa.array(found % size))
    return pa.Table.from_arrays(
        [
            *[name.take(pa.array(which)) for name in names],
            pa.concat_arrays([term, pa.nulls(len(groups), pa.string())]),
            pa.array(np.concatenate([n, empty]).astype(np.int64)),
            pa.array(np.concatenate([np.diff(heads, append=len(order)), empty]).astype(np.int64)),
        ],
        schema=COUNTED,
    )


def summed(tables: list[pa.Table]) -> pa.Table:
    whole_table = pa.concat_tables(tables)
    return whole_table.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(COUNTED.names)


def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task, summed while they fit ``HELD`` rows."""
    held: list[pa.Table] = []
    texts: list[bytes] = []
    langs: list[str] = []
    sources: list[str] = []
    size = 0
    for batch in batches:
        for text, lang, source in zip(*batch.columns, strict=True):
            texts.append(text.as_buffer().to_pybytes())
            langs.append(lang.as_py())
            sources.append(source.as_py())
            size += len(texts[-1]) + 1
            if size < SLICE:
                continue
            held.append(count_slice(texts, langs, sources))
            texts, langs, sources, size = [], [], [], 0
            if sum(table.num_rows for table in held) > HELD:
                held = [summed(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held[0].to_batches(max_chunksize=ROWS)
                    held = []
    if texts:
        held.append(count_slice(texts, langs, sources))
    if held:
        yield from summed(held).to_batches(max_chunksize=ROWS)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` summed over the corpus, partitioned by lang and term."""

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return (
        docs.select(text_of("text"), text_of("lang"), text_of("source"))
        .mapInArrow(count_texts, "lang string, source string, term string, n bigint, docs bigint")
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def vocabulary(counts: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term, n, vector)`` of kept terms, and of a row without a term per lang that lists its sources.

    ``vector`` holds ``(source, n)`` in order of the source; it is as long as a lang has sources.
    """
    return (
        counts.groupBy("lang", "term")
        .agg(
            F.sum("n").alias("n"),
            F.sum("docs").alias("docs"),
            F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"),
        )
        .where(F.col("term").isNull() | (F.col("docs") >= min_docs))
        .drop("docs")
    )


def group_sums(words: DataFrame) -> DataFrame:
    """``(lang, source, total)`` of every occurring group over kept terms."""
    return (
        words.select("lang", F.explode("vector").alias("_e"))
        .groupBy("lang", F.col("_e.source").alias("source"))
        .agg(F.sum("_e.n").alias("total"))
    )


def lang_sums(words: DataFrame) -> DataFrame:
    """``(lang, terms, all_total)``: number of kept terms and their occurrences."""
    return words.groupBy("lang").agg(F.count("term").alias("terms"), F.sum("n").alias("all_total"))


def whole(value: Column, divisor: Column) -> Column:
    """Integer division, also of decimals."""
    return F.call_function("div", value, divisor)


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + terms))``, exact beyond 64 bits."""
    scaled = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return whole(scaled, (total + terms).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; both are at most SCALE + 1, so the square fits 64 bits."""
    return whole((p - q) * (p - q), q)


def run_columns(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(lang, block, terms, columns)``: run-length columns of blocks of the ordered vocabulary.

    ``columns`` holds ``(source, starts, counts)``; a run ends where the next one starts.
    """
    entries = words.where(F.col("term").isNotNull()).groupBy("lang", "vector").agg(F.count("*").alias("_many"))
    kind = "array<struct<source:string,starts:array<bigint>,counts:array<bigint>>>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        lang, rows = None, []
        for batch in batches:
            for name, vector, many in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if rows and (name != lang or len(rows) == block):
                    yield encoded(lang, number, rows)
                    number, rows = number + 1, []
                lang = name
                rows.append((vector, many))
        if rows:
            yield encoded(lang, number, rows)

    keys = ["lang", "vector"]
    return (
        entries.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("lang", "vector", "_many")
        .mapInArrow(encode, f"lang string, block bigint, terms bigint, columns {kind}")
    )


def encoded(lang: str, number: int, rows: list[tuple[list[dict], int]]) -> pa.RecordBatch:
    """One block: every source's column as runs, absent sources left out (their column is one run of 0)."""
    runs: dict[str, tuple[list[int], list[int]]] = {}
    ends: dict[str, int] = {}
    at = 0
    for vector, many in rows:
        for entry in vector:
            starts, counts = runs.setdefault(entry["source"], ([0], [0]))
            if ends.get(entry["source"], 0) != at and counts[-1] != 0:
                starts.append(ends[entry["source"]])
                counts.append(0)
            if counts[-1] != entry["n"]:
                if starts[-1] == at:
                    counts[-1] = entry["n"]
                else:
                    starts.append(at)
                    counts.append(entry["n"])
            ends[entry["source"]] = at + many
        at += many
    columns = []
    for source, (starts, counts) in runs.items():
        if ends[source] < at and counts[-1] != 0:
            starts.append(ends[source])
            counts.append(0)
        columns.append({"source": source, "starts": starts, "counts": counts})
    kind = pa.list_(pa.struct([("source", pa.string()), ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([number], pa.int64()), pa.array([at], pa.int64()), pa.array([columns], kind)],
        names=["lang", "block", "terms", "columns"],
    )


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``share`` of whole columns: 64-bit while ``SCALE * (count + 1)`` fits, Python's integers beyond."""
    if len(counts) and int(counts.max()) + 1 >= (1 << 63) // SCALE:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + 1) // (total + terms)).astype(np.int64)


def pair_values(terms: int, left: tuple, right: tuple) -> tuple[int, int]:
    """Sum of ``f`` over a block with the left source as group, then with the right one."""
    starts = np.union1d(left[0], right[0])
    length = np.diff(starts, append=terms)
    a = left[1][np.searchsorted(left[0], starts, side="right") - 1]
    b = right[1][np.searchsorted(right[0], starts, side="right") - 1]
    square = (a - b) * (a - b)
    return int((square // b * length).sum()), int((square // a * length).sum())


def pair_sums(words: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """``(lang, source, item, value)``: summed ``f`` of every ordered pair of sources of a lang."""
    spark = words.sparkSession
    groups = group_sums(words)
    sums = lang_sums(words)
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("_groups"))
    tiled = (
        run_columns(words, block)
        .join(listed, "lang")
        .join(sums.select("lang", F.col("terms").alias("_all_terms")), "lang")
        .withColumn("_tile", F.explode(F.sequence(F.lit(0), ((F.size("_groups") - 1) / tile).cast("int"))))
        .select("lang", "terms", "columns", "_groups", "_all_terms", "_tile", "block")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "block", "_tile")
    )

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from block_pairs(batch.slice(row, 1).to_pylist()[0], tile)

    pieces = tiled.mapInArrow(intersect, "lang string, source string, item string, value bigint")
    found = pieces.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # A lang without kept terms has no block; its pairs are worth 0.
    empty = (
        listed.join(sums.where("terms = 0").select("lang"), "lang", "left_semi")
        .select("lang", "_groups", F.explode("_groups.source").alias("source"))
        .select("lang", "source", F.explode("_groups.source").alias("item"))
        .where("source <> item")
        .withColumn("value", F.lit(0).cast("bigint"))
    )
    return found.unionByName(empty)


def block_pairs(row: dict, tile: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one block whose left source lies in the tile; the right one stands behind it."""
    groups, terms = row["_groups"], row["terms"]
    known = {column["source"]: column for column in row["columns"]}
    columns = []
    for group in groups[row["_tile"] * tile :]:
        runs = known.get(group["source"], {"starts": [0], "counts": [0]})
        counts = np.array(runs["counts"], dtype=np.int64)
        columns.append((np.array(runs["starts"], dtype=np.int64), shares(counts, group["total"], row["_all_terms"])))
    names = [group["source"] for group in groups[row["_tile"] * tile :]]
    for left in range(min(tile, len(columns))):
        out: list[tuple[str, str, int]] = []
        for right in range(left + 1, len(columns)):
            a, b = pair_values(terms, columns[left], columns[right])
            out += [(names[left], names[right], a), (names[right], names[left], b)]
        if out:
            source, item, value = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * len(out)), pa.array(source), pa.array(item), pa.array(value, pa.int64())],
                names=["lang", "source", "item", "value"],
            )


def term_values(words: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of kept terms whose share in the source is above that in the lang."""
    entries = words.where(F.col("term").isNotNull()).select(
        "lang", F.col("term").alias("item"), F.col("n").alias("_all"), F.explode("vector").alias("_e")
    )
    return (
        entries.select("lang", "item", "_all", F.col("_e.source").alias("source"), F.col("_e.n").alias("_n"))
        .join(group_sums(words), ["lang", "source"])
        .join(lang_sums(words), "lang")
        .withColumn("_p", share(F.col("_n"), F.col("total"), F.col("terms")))
        .withColumn("_q", share(F.col("_all"), F.col("all_total"), F.col("terms")))
        .where("_n > 0 AND _p > _q")
        .select("lang", "source", "item", gap(F.col("_p"), F.col("_q")).alias("value"))
    )


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200, block: int = BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: parts ``pair`` (all) and ``term`` (``top_terms`` a group)."""
    words = cut_lineage(vocabulary(term_counts(docs), min_docs))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_sums(words, block).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = term_values(words).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order))
    return pairs.select(*columns).unionByName(terms.where(F.col("rank") <= top_terms).select(*columns))
