"""Ranked lexical search by two trees: all documents ranked for each item of a query set.

*Vectors.* A task keeps, of every document, its number of terms and the frequencies of those
terms that some item asks for. Their document frequencies, and the number and total length
of all documents, are summed in Spark.

*Trees.* Items are grouped by the commonest terms they share, documents of a block by the
group of items they score best with. A node of either tree holds, per term, the largest
weight (items) or saturated frequency (documents) below it. The product of two nodes bounds
every score between them.

*Search.* A task walks both trees of a block downwards at once and drops a pair of nodes
whose bound lies below the weakest of the item node's kth scores; the scores found in
earlier blocks of the task count. Leaves that stay are scored exactly, those with the
highest bounds first. Equal bounds stay, because a smaller id may win, so pruning never
changes the result. Each task hands on its best rows per item, and Spark ranks those.

Items are a stated query set; they are worked off in chunks of at most ``CHUNK`` items and
``CHUNK_TERMS`` terms, whose tree is the only thing shipped to the tasks. Weights and
saturated frequencies are whole numbers; their sums are exact in doubles below 2**53, and
beyond they are summed as 64-bit integers.

Defined results: null texts have no terms; an item without terms or matches has no rows;
rows of items that are equal count once, items of one id and different texts are ranked
apart; each row of ``docs`` ranks for itself, also when ids repeat; null ids rank behind
others of equal score; no other column is read; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.session import cut_lineage

#: Lower-cased byte of a term, or 0 where the byte stands in none.
TERMS = np.array([b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
CHUNK, CHUNK_TERMS = 2000, 200_000
#: Bytes of text that are cut into terms at once.
SLICE = 4 << 20
LEAF_ITEMS, LEAF_DOCS, FAN = 4, 16, 4
#: Documents of one block at most, and numbers in the maxima of its leaves.
BLOCK, CELLS = 4096, 4_000_000
#: Parts of the first of two rankings of the tasks' best rows.
SALTS = 64


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Text number and (coded) term of every term of some texts, in order."""
    data = TERMS[np.frombuffer(b" ".join(texts), np.uint8)]
    inside = data > 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, stop = edges[::2], edges[1::2]
    ends = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(stop - start, out=ends[1:])
    coded = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), start, side="right"), coded.dictionary_encode()


class Items:
    """One chunk of items: ids, their terms, and the vocabulary they share."""

    def __init__(self, rows: list[tuple]):
        doc, coded = terms_of([(text or "").encode() for _, text in rows]) if rows else (np.zeros(0, int), None)
        self.vocabulary = coded.dictionary if rows else pa.array([], pa.string())
        size = max(1, len(self.vocabulary))
        held = np.unique(doc * size + coded.indices.to_numpy()) if rows else np.zeros(0, int)
        self.terms = [held[a:b] % size for a, b in zip(*self._bounds(held // size, len(rows)), strict=True)]
        self.ids = [row[0] for row in rows]

    @staticmethod
    def _bounds(doc: np.ndarray, count: int) -> tuple[list[int], list[int]]:
        at = np.searchsorted(doc, np.arange(count + 1)).tolist()
        return at[:-1], at[1:]


class ItemTree:
    """Items in leaves of ``LEAF_ITEMS``; every node knows the terms of the items below it.

    A term weighs the same in every item, so a node's largest weight of a term is the
    term's weight if some item has it.
    """

    def __init__(self, items: Items, frequency: np.ndarray, documents: int):
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64
        )
        common = [tuple(sorted(terms.tolist(), key=lambda t: (-frequency[t], t))[:5]) for terms in items.terms]
        self.order = sorted((n for n in range(len(items.ids)) if len(items.terms[n])), key=lambda n: common[n])
        self.terms = items.terms
        longest = max((len(terms) for terms in items.terms), default=0)
        exact = longest * int(self.weight.max(initial=0)) * 1_000_000 < 1 << 53
        self.kind = np.float64 if exact else np.int64
        leaves = [self.order[at : at + LEAF_ITEMS] for at in range(0, len(self.order), LEAF_ITEMS)]
        #: Levels from the leaves up: ``(items, terms, number of the first child, number behind the last)``.
        self.levels = [[(leaf, self._union(leaf), 0, 0) for leaf in leaves]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            groups = [(at, min(at + FAN, len(below))) for at in range(0, len(below), FAN)]
            self.levels.append(
                [([n for node in below[a:b] for n in node[0]], self._union(n for node in below[a:b] for n in node[0]), a, b) for a, b in groups]
            )

    def _union(self, numbers) -> np.ndarray:
        return np.unique(np.concatenate([self.terms[n] for n in numbers]))

    def groups(self) -> list[np.ndarray]:
        """Terms of at most 16 groups of items, to order documents by."""
        level = next((level for level in self.levels if len(level) <= 16), self.levels[-1])
        return [node[1] for node in level]


class DocBlock:
    """Documents of a block in leaves of ``LEAF_DOCS``, with the largest frequency per term of every node."""

    def __init__(self, tree: ItemTree, ids: list, heads: np.ndarray, terms: np.ndarray, values: np.ndarray):
        lengths = np.diff(heads)
        rows = np.repeat(np.arange(len(ids)), lengths)
        groups = tree.groups()
        affinity = np.zeros((len(ids), len(groups)))
        for number, group in enumerate(groups):
            asked = np.zeros(len(tree.weight))
            asked[group] = tree.weight[group]
            affinity[:, number] = np.bincount(rows, weights=asked[terms] * values, minlength=len(ids))
        best = affinity.argmax(axis=1)
        order = np.lexsort((-affinity[np.arange(len(ids)), best], best))
        self.ids = [ids[n] for n in order.tolist()]
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        by = np.argsort(place[rows], kind="stable")
        self.rows, self.terms, self.values = place[rows][by], terms[by], values[by]
        self.heads = np.searchsorted(self.rows, np.arange(len(ids) + 1))
        leaf = np.zeros((-(-len(ids) // LEAF_DOCS), len(tree.weight)), dtype=tree.kind)
        np.maximum.at(leaf, (self.rows // LEAF_DOCS, self.terms), self.values)
        self.levels = [leaf]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def scores(self, tree: ItemTree, leaves: np.ndarray, items: list[int], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents in some leaves and their exact scores with some items."""
        places = (leaves[:, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
        places = places[places < len(self.ids)]
        lengths = self.heads[places + 1] - self.heads[places]
        row = np.repeat(np.arange(len(places)), lengths)
        entry = np.repeat(self.heads[places] - np.cumsum(lengths) + lengths, lengths) + np.arange(len(row))
        column = np.full(len(tree.weight), -1)
        column[terms] = np.arange(len(terms))
        at = column[self.terms[entry]]
        asked = at >= 0
        frequencies = np.zeros((len(places), len(terms)), dtype=tree.kind)
        frequencies[row[asked], at[asked]] = self.values[entry[asked]]
        weights = np.zeros((len(terms), len(items)), dtype=tree.kind)
        for number, item in enumerate(items):
            weights[column[tree.terms[item]], number] = tree.weight[tree.terms[item]]
        return places, (frequencies @ weights).astype(np.int64)


class Search:
    """The best documents so far of every item, over the blocks of a task."""

    def __init__(self, tree: ItemTree, limit: int):
        self.tree, self.limit = tree, limit
        self.best: dict[int, list[tuple]] = {item: [] for item in tree.order}
        self.least = dict.fromkeys(tree.order, 1)
        self.scored = 0

    def add(self, block: DocBlock) -> None:
        if self.tree.order:
            self._visit(len(self.tree.levels) - 1, 0, block, len(block.levels) - 1, np.zeros(1, dtype=np.int64))

    def _visit(self, height: int, number: int, block: DocBlock, depth: int, nodes: np.ndarray) -> None:
        items, terms, first, last = self.tree.levels[height][number]
        bounds = block.levels[depth][np.ix_(nodes, terms)] @ self.tree.weight[terms].astype(self.tree.kind)
        weakest = min(self.least[item] for item in items)
        nodes, bounds = nodes[bounds >= weakest], bounds[bounds >= weakest]
        if not len(nodes):
            return
        if depth:
            below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = below[below < len(block.levels[depth - 1])]
        if height:
            for child in range(first, last):
                self._visit(height - 1, child, block, max(0, depth - 1), nodes)
        elif depth:
            self._visit(0, number, block, depth - 1, nodes)
        else:
            self._score(block, nodes[np.argsort(-bounds, kind="stable")], np.sort(bounds)[::-1], items, terms)

    def _score(self, block: DocBlock, leaves: np.ndarray, bounds: np.ndarray, items: list[int], terms: np.ndarray) -> None:
        """Score leaves from the highest bound down, in growing steps, until the bounds fall below what is held."""
        at, step = 0, 4
        while at < len(leaves) and bounds[at] >= min(self.least[item] for item in items):
            places, scores = block.scores(self.tree, leaves[at : at + step], items, terms)
            self.scored += len(places) * len(items)
            for number, item in enumerate(items):
                for place in np.flatnonzero(scores[:, number] >= self.least[item]).tolist():
                    doc = block.ids[places[place]]
                    self.best[item].append((-int(scores[place, number]), doc is None, doc if doc is not None else 0))
                self.best[item] = sorted(self.best[item])[: self.limit]
                if len(self.best[item]) == self.limit:
                    self.least[item] = -self.best[item][-1][0]
            at, step = at + step, step * 2


def doc_vectors(docs: DataFrame, items: Items) -> DataFrame:
    """``(_doc, _n, _terms, _times)`` of every document with a term; ``_terms`` are numbers in the items' vocabulary."""
    vocabulary = items.vocabulary

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                held.append((doc.as_py(), text.as_buffer().to_pybytes()))
                size += len(held[-1][1]) + 1
                if size >= SLICE:
                    yield vectors(held, batch.schema.field(0).type)
                    held, size = [], 0
        if held:
            yield vectors(held, batch.schema.field(0).type)

    def vectors(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        doc, coded = terms_of([text for _, text in held])
        n = np.bincount(doc, minlength=len(held))
        known = pc.index_in(coded.dictionary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        term = known[coded.indices.to_numpy()] if len(doc) else np.zeros(0, np.int64)
        width = max(1, len(vocabulary))
        entry, times = np.unique((doc * width + term)[term >= 0], return_counts=True)
        used = np.flatnonzero(n)
        ends = np.append(0, np.searchsorted(entry // width, used, side="right")).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[at][0] for at in used.tolist()], kind),
                pa.array(n[used].astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((entry % width).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64))),
            ],
            names=["_doc", "_n", "_terms", "_times"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        scan, f"_doc {kind}, _n bigint, _terms array<int>, _times array<bigint>"
    )


def saturated(times: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``(10**9 * tf) div (1000 * tf + 8 * m)`` with ``m`` from the length ``n`` of the entry's document."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        stretch = np.array([90 * int(value) * documents // total for value in n], dtype=np.int64)
    else:
        stretch = 90 * n * documents // total
    return 1_000_000_000 * times // (1000 * times + 8 * (10 + stretch))


def search_chunk(docs: DataFrame, items: Items, limit: int) -> DataFrame:
    """``(_item, doc_id, score, rank)`` for the items of one chunk; ``_item`` is the number of an item."""
    found = cut_lineage(doc_vectors(docs, items))
    sums = found.agg(F.count("*").alias("documents"), F.sum("_n").alias("total")).first()
    frequency = np.zeros(len(items.vocabulary), dtype=np.int64)
    for row in found.select(F.explode("_terms").alias("_term")).groupBy("_term").count().toLocalIterator():
        frequency[row["_term"]] = row["count"]
    documents, total = sums["documents"], sums["total"] or 1
    tree = ItemTree(items, frequency, documents)
    size = LEAF_DOCS * max(1, min(BLOCK // LEAF_DOCS, CELLS // max(1, len(frequency))))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, kind = Search(tree, limit), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, size):
                ids, n, terms, times = batch.slice(at, size).columns
                heads = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy())).astype(np.int64)
                lengths = np.repeat(n.to_numpy(), np.diff(heads))
                values = saturated(times.flatten().to_numpy(), lengths, documents, total)
                search.add(DocBlock(tree, ids.to_pylist(), heads, terms.flatten().to_numpy().astype(np.int64), values))
        rows = [(item, doc, score) for item, held in search.best.items() for score, _, doc in held]
        if rows:
            nameless = [none for held in search.best.values() for _, none, _ in held]
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item, pa.int32()),
                    pa.array([None if none else value for value, none in zip(doc, nameless, strict=True)], kind),
                    pa.array([-value for value in score], pa.int64()),
                    pa.array([TaskContext.get().partitionId() % SALTS] * len(rows), pa.int32()),
                ],
                names=["_item", "doc_id", "score", "_salt"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    best = found.where(F.size("_terms") > 0).mapInArrow(walk, f"_item int, doc_id {kind}, score bigint, _salt int")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("_item", "_salt").orderBy(*order)))
    return (
        some.where(F.col("rank") <= limit)
        .withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order)))
        .where(F.col("rank") <= limit)
        .drop("_salt")
    )


def chunks_of(items: DataFrame, chunk: int, chunk_terms: int) -> Iterator[list[tuple]]:
    """Distinct items, as many as fit a chunk; one chunk is on the driver at a time."""
    held, size = [], 0
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "") // 2
        if len(held) == chunk or size > chunk_terms:
            yield held
            held, size = [], 0
    if held:
        yield held


def rank_documents(docs: DataFrame, items: DataFrame, limit: int = 10, chunk: int = CHUNK) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``limit`` best documents of every item."""
    spark = docs.sparkSession
    item_kind, doc_kind = (f.schema[c].dataType.simpleString() for f, c in ((items, "item_id"), (docs, "doc_id")))
    schema = f"item_id {item_kind}, rank int, doc_id {doc_kind}, score bigint"
    results = [spark.createDataFrame([], schema)]
    for rows in chunks_of(items, chunk, CHUNK_TERMS):
        held = Items(rows)
        names = spark.createDataFrame(list(enumerate(held.ids)), f"_item int, item_id {item_kind}")
        results.append(search_chunk(docs, held, limit).join(names, "_item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, results)
