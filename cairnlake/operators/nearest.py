"""Nearest-neighbour index: coarse centroids, inverted lists cut into rings, exact search.

Every vector lies in the list of its nearest centroid and keeps its distance to it (its
gap). Lists are cut into rings by gap. For a query at distance ``d`` from a centroid, no
vector of a ring with gaps in ``[low, high]`` is nearer than ``max(d - high, low - d)``, by
the triangle inequality, so rings beyond a query's kth distance are skipped without loss.

Centroids are fitted on a bounded sample of the vectors (``fit``); every vector is listed.
The centroids and one line per ring are all that is shipped to tasks: at most ``MOST_LISTS``
lists of ``RINGS`` rings, at any number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.functions.params import SEARCH_LIMIT
from cairnlake.operators.vectors import BLOCK_ROWS, _matrix, _nearest, similarity_of
from cairnlake.session import cut_lineage

MOST_LISTS = 1024
RINGS = 4
FIT = 20_000
#: Distances are compared with this slack, so that rounding never skips a neighbour.
SLACK = 1e-9
UNIT = ["list", "ring", "part"]


@dataclass
class NearestIndex:
    """``rows``: ``(id, embedding, list, gap, ring, part)``; ``rings``: ``(list, ring, rows, low, high, parts)``."""

    rows: DataFrame
    centroids: np.ndarray
    rings: np.ndarray

    def save(self, folder: str) -> None:
        """The lists as partitions, so that a search reads only those it visits."""
        spark = self.rows.sparkSession
        self.rows.repartition(*UNIT).sortWithinPartitions("list", "gap").write.partitionBy("list").parquet(f"{folder}/rows")
        spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(self.centroids)], "list int, center array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        spark.createDataFrame(self.rings.tolist(), "list double, ring double, rows double, low double, high double, parts double").coalesce(1).write.parquet(f"{folder}/rings")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> NearestIndex:
        centers = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()
        rings = spark.read.parquet(f"{folder}/rings").orderBy("list", "ring").collect()
        return NearestIndex(
            spark.read.parquet(f"{folder}/rows"), np.array([row["center"] for row in centers]), np.array([list(row) for row in rings])
        )


def fitted_centroids(sample: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centroids of a sample by a few rounds of means, started from spread-out rows."""
    picks = [0]
    gap = np.square(sample - sample[0]).sum(axis=1)
    while len(picks) < lists and gap.max(initial=0) > 0:
        picks.append(int(gap.argmax()))
        gap = np.minimum(gap, np.square(sample - sample[picks[-1]]).sum(axis=1))
    centers = sample[picks]
    for _ in range(rounds):
        near = nearest_centers(sample, centers)[0]
        sizes = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers


def nearest_centers(matrix: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the distance to it."""
    rough = np.square(centers).sum(axis=1) - 2 * matrix @ centers.T
    near = rough.argmin(axis=1)
    return near, np.sqrt(np.square(matrix - centers[near]).sum(axis=1))


def build_index(vectors: DataFrame, lists: int | None = None, fit: int = FIT, part_rows: int = BLOCK_ROWS) -> NearestIndex:
    """Index of ``(id, embedding)``; rows without an embedding are left out.

    A ring of more than ``part_rows`` rows is cut into parts by a hash of the id, so many
    equal vectors spread over tasks.
    """
    stored = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    count = stored.count()
    lists = lists or min(MOST_LISTS, max(1, int(count**0.5)))
    sample = stored.orderBy(F.xxhash64("id")).limit(fit).select("embedding").toArrow().column(0)
    centers = fitted_centroids(_matrix(sample), lists) if count else np.zeros((0, 0))
    kind = dict(stored.dtypes)["id"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, gap = nearest_centers(_matrix(batch.column("embedding")), centers)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.astype(np.int32)), pa.array(gap)], names=["id", "embedding", "list", "gap"]
                )

    listed = cut_lineage(stored.mapInArrow(assign, f"id {kind}, embedding {dict(stored.dtypes)['embedding']}, list int, gap double"))
    edges = listed.groupBy("list").agg(
        F.percentile_approx("gap", [n / RINGS for n in range(1, RINGS)], 1000).alias("_edges")
    )
    ringed = listed.join(edges, "list").withColumn("ring", F.size(F.filter("_edges", lambda e: e < F.col("gap"))))
    spans = ringed.groupBy("list", "ring").agg(F.count("*").alias("rows"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    rings = spans.withColumn("parts", F.ceil(F.col("rows") / part_rows)).orderBy("list", "ring").collect()
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for r in rings for v in (r["list"] * RINGS + r["ring"], r["parts"])]), F.col("list") * RINGS + F.col("ring")), F.lit(1)) if rings else F.lit(1)
    rows = ringed.drop("_edges").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    table = np.array([[r[c] for c in ("list", "ring", "rows", "low", "high", "parts")] for r in rings], dtype=float)
    return NearestIndex(rows, centers, table.reshape(-1, 6))


class Bounds:
    """Which rings a query visits: first those that hold its nearest rows, then all within its kth distance."""

    def __init__(self, index: NearestIndex, limit: int):
        self.centers, self.rings, self.limit = index.centroids, index.rings, limit
        self.list = self.rings[:, 0].astype(int)

    def of(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bound of the distance to every ring, and the rings visited first."""
        if not len(self.rings):
            return np.zeros(0), np.zeros(0, dtype=int)
        far = np.sqrt(np.square(self.centers - vector).sum(axis=1))[self.list]
        low = np.maximum(0.0, np.maximum(far - self.rings[:, 4], self.rings[:, 3] - far))
        order = np.lexsort((far, low))
        enough = int(np.searchsorted(np.cumsum(self.rings[order, 2]), self.limit)) + 1
        return low, order[:enough]


def _visits(queries: DataFrame, bounds: Bounds, blocks: int, first: bool) -> DataFrame:
    """``(query_id, embedding, kth, block, list, ring, part)``: one row per ring part that a query visits."""
    kind = dict(queries.dtypes)["query_id"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, rings, kth = [], [], batch.column("kth").to_numpy(zero_copy_only=False)
                for row, vector in enumerate(_matrix(batch.column("embedding"))):
                    low, home = bounds.of(vector)
                    if first:
                        chosen = home
                    else:
                        near = low <= np.sqrt(kth[row]) * (1 + SLACK) + SLACK
                        near[home] = False
                        chosen = np.flatnonzero(near)
                    rows.extend([row] * len(chosen))
                    rings.extend(chosen.tolist())
                picked = bounds.rings[rings]
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(rows, pa.int64())).columns]
                    + [pa.array(picked[:, column].astype(np.int32)) for column in (0, 1, 5)],
                    names=["query_id", "embedding", "kth", "block", "list", "ring", "parts"],
                )

    asked = queries.select(
        "query_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        "kth",
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
    )
    schema = f"query_id {kind}, embedding array<double>, kth double, block int, list int, ring int, parts int"
    return asked.mapInArrow(visit, schema).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _compared(visits: DataFrame, index: NearestIndex, limit: int) -> DataFrame:
    """``(query_id, id, distance)``: the best rows of every visited ring part."""
    kinds = dict(visits.dtypes)["query_id"], dict(index.rows.dtypes)["id"]
    centers = index.centroids
    keys = ["block", *UNIT]
    wanted = visits.select(*[F.col(key).alias(f"_{key}") for key in keys]).distinct()
    same = [F.col(key) == F.col(f"_{key}") for key in UNIT]
    stored = index.rows.join(wanted, same).select("id", "embedding", "gap", *[f"_{key}" for key in keys])

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asked.num_rows and held.num_rows:
            ids, matrix = held.column("id").to_numpy(), _matrix(held.column("embedding"))
            gaps, center = held.column("gap").to_numpy(), centers[asked.column("list")[0].as_py()]
            kth = asked.column("kth").to_numpy()
            for row, (query, vector) in enumerate(zip(asked.column("query_id").to_pylist(), _matrix(asked.column("embedding")), strict=True)):
                far = np.sqrt(np.square(vector - center).sum())
                near = np.flatnonzero(np.abs(far - gaps) <= np.sqrt(kth[row]) * (1 + SLACK) + SLACK)
                distances = np.square(matrix[near] - vector).sum(axis=1)
                keep = _nearest(distances, ids[near], limit)
                found.extend(zip([query] * len(keep), ids[near][keep].tolist(), distances[keep].tolist(), strict=True))
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        types = (asked.column("query_id").type, held.column("id").type, pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "id", "distance"])

    return visits.groupBy(*keys).cogroup(stored.groupBy(*[f"_{key}" for key in keys])).applyInArrow(
        compare, f"query_id {kinds[0]}, id {kinds[1]}, distance double"
    )


def index_knn(queries: DataFrame, index: NearestIndex, limit: int = SEARCH_LIMIT[0], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``limit`` nearest indexed vectors of every ``(query_id, embedding)``, exactly; ties by id.

    A query first visits the rings at its place until they hold ``limit`` rows; the kth
    distance found there decides which other rings are read. Tasks compare one block of
    queries with one part of a ring, so neither side of a task grows with the tables.
    """
    bounds = Bounds(index, limit)
    blocks = max(1, -(-queries.count() // block_rows))
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", F.lit(float("inf")).alias("kth"))
    place = Window.partitionBy("query_id").orderBy("distance", "id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)

    first = cut_lineage(best(_compared(_visits(asked, bounds, blocks, True), index, limit)).drop("place"))
    reach = first.groupBy("query_id").agg(
        F.when(F.count("*") >= limit, F.max("distance")).otherwise(F.lit(float("inf"))).alias("kth")
    )
    second = _compared(_visits(asked.drop("kth").join(reach, "query_id"), bounds, blocks, False), index, limit)
    return best(first.unionByName(second)).select("query_id", "place", "id", similarity_of(F.col("distance")).alias("similarity"))


def visited_share(queries: DataFrame, index: NearestIndex, limit: int = SEARCH_LIMIT[0]) -> DataFrame:
    """One row ``(pairs, all_pairs)``: pairs of query and ring row read by the second step's bounds, and all."""
    found = index_knn(queries, index, limit).groupBy("query_id").agg((1 - F.min("similarity") + 5e-4).alias("kth"))
    bounds = Bounds(index, limit)
    visits = [_visits(queries.select("query_id", "embedding").join(found, "query_id"), bounds, 1, step) for step in (True, False)]
    rows = queries.sparkSession.createDataFrame(index.rings[:, :3].tolist(), "list double, ring double, rows double")
    read = visits[0].unionByName(visits[1]).select("query_id", "list", "ring").distinct().join(rows, ["list", "ring"])
    every = queries.count() * int(index.rings[:, 2].sum())
    return read.agg(F.sum("rows").cast("long").alias("pairs")).withColumn("all_pairs", F.lit(every).cast("long"))
