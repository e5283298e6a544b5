"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated by a random orthogonal matrix and split into low-dimensional
blocks. Two vectors within squared distance ``d`` (``2 - 2 * cosine``) are, in at least one
block, within the block's proportional share of ``d``. So each block is range-joined by
itself: quantile cuts of its coordinates make cells, and a vector goes to every cell that
its box of half the block's radius reaches. In a cell, pairs within the block's budget are
candidates; their cosine is then computed from the original vectors in double precision.
A linked pair met in several cells or blocks is counted in the first one only.

Identical vectors of one label are one row with a weight. A cell that many rows share is
cut into chunks, and pairs of chunks are separate groups, so no task holds a large cell;
a group hands on link counts and a spanning star per connected part, never all its pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and rows with a null label or id, link with nothing and stay alone; only vectors of equal
length are compared; rows with one id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.components import components
from cairnlake.session import cut_lineage

CHUNK = 1024
SAMPLE = 4096
KEY = ["_label", "_embedding"]
SLACK = 1e-9


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction."""
    strange = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~strange & F.exists(embedding, lambda x: x != 0), F.lit(False))


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def directions(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Grid:
    """Blocks of the rotated space and the cuts of each block's coordinates.

    ``levels`` binary cuts per block are dealt over its coordinates in turn, at quantiles
    of a sample; cuts only balance the cells, the result does not depend on them.
    """

    def __init__(self, size: int, squared: float, blocks: int, levels: int, sample: np.ndarray):
        self.rotation = rotation(size)
        blocks = min(blocks, size)
        self.parts = np.array_split(np.arange(size), blocks)
        self.budgets = [squared * len(part) / size + SLACK for part in self.parts]
        rotated = directions(sample) @ self.rotation if len(sample) else np.zeros((1, size))
        self.cuts: list[list[tuple[int, np.ndarray]]] = []
        for part in self.parts:
            bits = [levels // len(part) + (n < levels % len(part)) for n in range(len(part))]
            self.cuts.append(
                [
                    (axis, np.quantile(rotated[:, axis], np.arange(1, 1 << b) / (1 << b)))
                    for axis, b in zip(part, bits, strict=True)
                    if b
                ]
            )

    def rotate(self, vectors: np.ndarray) -> np.ndarray:
        return directions(vectors) @ self.rotation

    def reach(self, rotated: np.ndarray, block: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """First and last cell per cut coordinate, with the number of its cells."""
        half = math.sqrt(self.budgets[block]) / 2 + SLACK
        return [
            (
                np.searchsorted(cuts, rotated[:, axis] - half, side="right"),
                np.searchsorted(cuts, rotated[:, axis] + half, side="right"),
                len(cuts) + 1,
            )
            for axis, cuts in self.cuts[block]
        ]

    def cells(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` for every cell that the box of a row reaches."""
        rows, cell = np.arange(len(rotated)), np.zeros(len(rotated), dtype=np.int64)
        for low, high, count in self.reach(rotated, block):
            spans = (high - low + 1)[rows]
            first = np.repeat(np.cumsum(spans) - spans, spans)
            step = np.arange(len(first)) - first
            rows, cell = np.repeat(rows, spans), np.repeat(cell, spans)
            cell = cell * count + low[rows] + step
        return rows, cell

    def first_common(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        """The lowest cell that the boxes of both rows of a pair reach."""
        cell = np.zeros(len(a), dtype=np.int64)
        for (low_a, _, count), (low_b, _, _) in zip(self.reach(a, block), self.reach(b, block), strict=True):
            cell = cell * count + np.maximum(low_a, low_b)
        return cell

    def block_distances(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        part = self.parts[block]
        return np.square(a[:, part] - b[:, part]).sum(axis=1)


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten(), dtype=np.float64).reshape(-1, size)


def linked_pairs(
    grid: Grid, block: int, cell: int, vectors: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Linked pairs of rows of ``left`` and ``right`` with whether this cell and block count them."""
    rotated, units = grid.rotate(vectors), directions(vectors)
    part, budget = grid.parts[block], grid.budgets[block]
    norms = np.square(rotated[:, part]).sum(axis=1)
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        squared = norms[some][:, None] + norms[right][None, :] - 2 * rotated[np.ix_(some, part)] @ rotated[np.ix_(right, part)].T
        i, k = np.nonzero(squared <= budget + SLACK)
        a, b = some[i], right[k]
        keep = a != b
        a, b = a[keep], b[keep]
        close = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
        a, b = a[close], b[close]
        counts = grid.first_common(rotated[a], rotated[b], block) == cell
        for earlier in range(block):
            counts &= grid.block_distances(rotated[a], rotated[b], earlier) > grid.budgets[earlier]
        # The block's own budget is judged by one formula, so that exactly one block counts a pair.
        counts &= grid.block_distances(rotated[a], rotated[b], block) <= budget
        yield a, b, counts


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest row connected to each row."""
    lowest = np.arange(n)
    while len(a):
        before = lowest.copy()
        np.minimum.at(lowest, a, lowest[b])
        np.minimum.at(lowest, b, lowest[a])
        lowest = lowest[lowest]
        if (lowest == before).all():
            break
    return lowest


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, blocks: int = 8, cell_rows: int = 2048
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``(vec_id, embedding, label)``.

    ``cell_rows`` is the size of a cell at which the number of cuts aims.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").alias("_label"), F.col("embedding").alias("_embedding"))
    good = F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_embedding"))
    classes = cut_lineage(
        rows.where(good).groupBy(*KEY).agg(F.min("vec_id").alias("_node"), F.count("*").alias("_weight"))
    )
    shape = classes.groupBy("_label", F.size("_embedding").alias("_size")).count().cache()
    largest = shape.agg(F.max("count").alias("n")).first()["n"] or 0
    sizes = [row["_size"] for row in shape.groupBy("_size").agg(F.sum("count").alias("n")).orderBy(F.desc("n")).limit(64).collect()]
    shape.unpersist()
    levels = max(0, math.ceil(math.log2(max(1, largest) / cell_rows)))
    sampled = classes.orderBy(F.xxhash64("_node")).limit(SAMPLE).select("_embedding").collect()
    drawn: dict[int, list] = {}
    for row in sampled:
        drawn.setdefault(len(row["_embedding"]), []).append(row["_embedding"])
    squared = 2 - 2 * cosine
    made: dict[int, Grid] = {}

    def grid_of(size: int) -> Grid:
        """Lengths outside the sample get a grid without cuts."""
        if size not in made:
            known = np.array(drawn.get(size, []), dtype=np.float64).reshape(-1, size)
            made[size] = Grid(size, squared, blocks, levels if len(known) else 0, known)
        return made[size]

    for size in sizes:
        grid_of(size)
    kind = dict(classes.dtypes)
    label_type, vector_type, node_type = kind["_label"], kind["_embedding"], kind["_node"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("_embedding").value_lengths())
            for size in np.unique(lengths):
                chosen = batch.take(pa.array(np.flatnonzero(lengths == size)))
                grid = grid_of(int(size))
                rotated = grid.rotate(matrix(chosen.column("_embedding"), int(size)))
                for block in range(len(grid.parts)):
                    where, cell = grid.cells(rotated, block)
                    for at in range(0, len(where), 8192):
                        taken = chosen.take(pa.array(where[at : at + 8192]))
                        n = taken.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [
                                taken.column("_label"),
                                pa.array(np.full(n, size, dtype=np.int32)),
                                pa.array(np.full(n, block, dtype=np.int32)),
                                pa.array(cell[at : at + 8192]),
                                taken.column("_node"),
                                taken.column("_weight"),
                                taken.column("_embedding"),
                            ],
                            names=["_label", "_size", "_block", "_cell", "_node", "_weight", "_embedding"],
                        )

    cell_key = ["_label", "_size", "_block", "_cell"]
    placed = classes.mapInArrow(
        place,
        f"_label {label_type}, _size int, _block int, _cell bigint, _node {node_type}, _weight bigint, _embedding {vector_type}",
    )
    counted = placed.groupBy(*cell_key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    chunk = F.pmod(F.xxhash64("_node"), F.col("_chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    dealt = (
        placed.join(counted.where("_chunks > 1"), cell_key, "left")
        .withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
        .withColumn("_chunk", chunk)
        .select("*", other.alias("_other"))
        .withColumn("_low", F.least("_chunk", "_other"))
        .withColumn("_high", F.greatest("_chunk", "_other"))
        .drop("_chunks", "_other")
    )

    def join_chunks(key: tuple, table: pa.Table) -> pa.Table:
        _, size, block, cell, low, high = (part.as_py() for part in key)
        grid = grid_of(size)
        values = matrix(table.column("_embedding"), size)
        chunks, weights = np.asarray(table.column("_chunk")), np.asarray(table.column("_weight"))
        left, right = np.flatnonzero(chunks == low), np.flatnonzero(chunks == high)
        links = np.zeros(len(values), dtype=np.int64)
        lowest = np.arange(len(values))
        for a, b, counts in linked_pairs(grid, block, cell, values, left, right, cosine):
            np.add.at(links, a[counts], weights[b[counts]])
            if low != high:
                np.add.at(links, b[counts], weights[a[counts]])
            lowest = np.minimum(lowest, spanning_from(lowest, a, b))
        touched = np.flatnonzero((links > 0) | (lowest != np.arange(len(values))))
        nodes = table.column("_node").combine_chunks()
        return pa.table(
            {
                "_node": nodes.take(pa.array(touched)),
                "_top": nodes.take(pa.array(lowest[touched])),
                "_links": pa.array(links[touched]),
            }
        )

    found = cut_lineage(
        dealt.groupBy("_label", "_size", "_block", "_cell", "_low", "_high").applyInArrow(
            join_chunks, f"_node {node_type}, _top {node_type}, _links bigint"
        )
    )
    parts = components(found, "_node", "_top")
    counts = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    known = (
        classes.join(counts, "_node", "left")
        .join(parts, "_node", "left")
        .select(
            F.col("_label").alias("_l"),
            F.col("_embedding").alias("_e"),
            (F.coalesce("_links", F.lit(0)) + F.col("_weight") - 1).alias("_n"),
            F.coalesce("_component", "_node").alias("_c"),
        )
    )
    joined = rows.join(known, good & (F.col("_label") == F.col("_l")) & (F.col("_embedding") == F.col("_e")), "left")
    component = F.coalesce("_c", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def spanning_from(lowest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``lowest`` after the pairs ``(a, b)`` join the parts that are known so far."""
    roots = spanning(len(lowest), lowest[a], lowest[b])
    return roots[lowest]
