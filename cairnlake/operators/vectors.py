"""Vector search over stored embeddings and a deterministic text embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.functions.params import SEARCH_LIMIT
from cairnlake.functions.partitions import deal_reads
from cairnlake.functions.text import half_even, tokens

Encoder = Callable[[Sequence], np.ndarray]

# Rows of one block of the block join; 8192 x 384 doubles are about 25 MB per side.
BLOCK_ROWS = 8192
# Texts of one call of an encoder.
ENCODED_ROWS = 128
# Queries of one matrix product, and the rounding of its distances per dimension.
SLICE_ROWS = 128
ROUNDING = 1e-15


def similarity_of(distance: Column) -> Column:
    """One minus the squared distance, three places; a missing distance counts as 1."""
    return half_even(1.0 - F.coalesce(distance, F.lit(0.0)), 3)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(rows.flatten(), dtype=np.float64)
    return flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 0)


def _squared_distances(queries: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Exact differences, one query at a time, so memory stays at one block."""
    return np.stack([np.square(stored - query).sum(axis=1) for query in queries])


def _nearest(distances: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    return np.lexsort((ids, distances))[:limit]


def nearest_rows(queries: np.ndarray, stored: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, stored rows and exact distances of the ``limit`` nearest stored rows of each query, ties by id.

    A matrix product gives all distances up to rounding; only rows within that rounding
    of a query's kth distance are measured by differences.
    """
    lengths = np.square(stored).sum(axis=1)
    found = []
    for start in range(0, len(queries), SLICE_ROWS):
        asked = queries[start : start + SLICE_ROWS]
        rough = lengths - 2 * (asked @ stored.T)
        kth = np.partition(rough, min(limit, len(stored)) - 1, axis=1)[:, min(limit, len(stored)) - 1]
        slack = ROUNDING * stored.shape[1] * (lengths.max() + np.square(asked).sum(axis=1))
        # A distance that is no number passes, and sorts last.
        rows, at = np.nonzero(~(rough > (kth + slack)[:, None]))
        distances = np.empty(len(rows))
        for n in range(0, len(rows), BLOCK_ROWS):
            part = slice(n, n + BLOCK_ROWS)
            distances[part] = np.square(stored[at[part]] - asked[rows[part]]).sum(axis=1)
        order = np.lexsort((ids[at], distances, rows))
        rows, at, distances = rows[order], at[order], distances[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < limit
        found.append((rows[keep] + start, at[keep], distances[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def vector_search(
    vectors: DataFrame, query: Sequence[float], limit: int = SEARCH_LIMIT[0], wing: str | None = None
) -> DataFrame:
    """The ``limit`` stored vectors nearest to ``query`` by squared Euclidean distance.

    Every Arrow batch hands on its own best rows only, so the final sort sees
    ``limit`` rows per batch instead of the whole table.
    """
    target = np.asarray(query, dtype=np.float64)
    scope = vectors if wing is None else vectors.where(F.col("wing") == wing)
    id_type = dict(scope.dtypes)["id"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            distances = _squared_distances(target[None, :], _matrix(batch.column("embedding")))[0]
            keep = _nearest(distances, batch.column("id").to_numpy(zero_copy_only=False), limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep)), batch.column("wing").take(pa.array(keep)), pa.array(distances[keep])],
                names=["id", "wing", "distance"],
            )

    return (
        scope.select("id", "wing", "embedding")
        .mapInArrow(nearest, f"id {id_type}, wing string, distance double")
        .orderBy("distance", "id")
        .limit(limit)
        .select("id", "wing", similarity_of(F.col("distance")).alias("similarity"))
    )


def knn_join(queries: DataFrame, vectors: DataFrame, limit: int = SEARCH_LIMIT[0], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``limit`` nearest stored vectors of every query, exactly.

    A blocked join: both sides are cut into blocks of about ``block_rows`` rows, every
    task compares one query block with one stored block and emits only the best rows
    of each query. No side is broadcast or collected; the stored side is replicated
    once per query block, which is once for any query set that fits one block. Rows
    without an embedding take no part.
    """
    queries, vectors = (side.where(F.col("embedding").isNotNull()) for side in (queries, vectors))
    query_blocks = max(1, -(-queries.count() // block_rows))
    stored_blocks = max(1, -(-vectors.count() // block_rows))
    id_type = dict(vectors.dtypes)["id"]
    query_type = dict(queries.dtypes)["query_id"]

    def block(key: str, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select("query_id", "embedding", block("query_id", query_blocks).alias("qb")).select(
        "*", every(stored_blocks).alias("sb")
    )
    right = vectors.select("id", "embedding", block("id", stored_blocks).alias("sb")).select(
        "*", every(query_blocks).alias("qb")
    )

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows = at = np.zeros(0, dtype=np.int64)
        distances = np.zeros(0)
        if asked.num_rows and held.num_rows:
            numbers = held.column("id").to_numpy()
            rows, at, distances = nearest_rows(_matrix(asked.column("embedding")), _matrix(held.column("embedding")), numbers, limit)
        columns = [asked.column("query_id").take(pa.array(rows)), held.column("id").take(pa.array(at)), pa.array(distances)]
        return pa.table(columns, names=["query_id", "id", "distance"])

    partial = (
        deal_reads(left, "qb", "sb")
        .groupBy("qb", "sb")
        .cogroup(deal_reads(right, "qb", "sb").groupBy("qb", "sb"))
        .applyInArrow(compare, f"query_id {query_type}, id {id_type}, distance double")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return (
        partial.withColumn("place", place)
        .where(F.col("place") <= limit)
        .select("query_id", "place", "id", similarity_of(F.col("distance")).alias("similarity"))
    )


def mean_vectors(vectors: DataFrame, key: str = "wing") -> DataFrame:
    """Element-wise mean per key; partial sums are combined before the shuffle."""
    elements = vectors.select(key, F.posexplode("embedding").alias("position", "value"))
    means = elements.groupBy(key, "position").agg(F.avg(F.col("value").cast("double")).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "value")))
    return means.groupBy(F.col(key).alias("query_id")).agg(F.transform(ordered, lambda e: e["value"]).alias("embedding"))


def hash_tokens(dimensions: int) -> Encoder:
    """Encoder over token lists for when no model is at hand.

    The first eight hex digits of a token's MD5 pick the element, the ninth its
    sign; the summed vector is scaled to unit length.
    """

    def encode(rows: Sequence[Sequence[str]]) -> np.ndarray:
        known: dict[str, tuple[int, int]] = {}
        out = np.zeros((len(rows), dimensions))
        for vector, words in zip(out, rows):
            for word in words or ():
                if word not in known:
                    digest = md5(word.encode()).hexdigest()
                    known[word] = (int(digest[:8], 16) % dimensions, 1 if int(digest[8], 16) < 8 else -1)
                at, sign = known[word]
                vector[at] += sign
        length = np.sqrt(np.square(out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)

    return encode


def embed(df: DataFrame, text: str = "text", encoder: Encoder | None = None, dimensions: int = 384) -> DataFrame:
    """Add ``embedding``; ``encoder`` turns a list of texts into one vector per text.

    Any sentence model fits the encoder slot and is called with at most ``ENCODED_ROWS``
    texts, so that a task never holds a whole Arrow batch as Python objects. The default
    hashes tokens, which are cut in the JVM.
    """
    encode = encoder or hash_tokens(dimensions)
    prepared = df.withColumn("_input", F.col(text) if encoder else tokens(F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ENCODED_ROWS) for whole in batches for at in range(0, whole.num_rows, ENCODED_ROWS)):
            encoded = np.asarray(encode(batch.column("_input").to_pylist()), dtype=np.float32)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * encoded.shape[1])
            vectors = pa.ListArray.from_arrays(offsets, pa.array(encoded.reshape(-1)))
            kept = [name for name in batch.schema.names if name != "_input"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), vectors], names=[*kept, "embedding"])

    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return prepared.mapInArrow(run, schema)
