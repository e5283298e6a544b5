"""Document fingerprints: quartile bucket digests.

Every byte triplet of a text (three patterns in a window of four bytes) is hashed into one
of 128 buckets. The digest holds a checksum byte, the length on a logarithmic scale, the
ratios of the bucket quartiles and, per bucket, the quartile its count falls into (two
bits), as hexadecimal text. The difference of two digests adds the distances of all parts
and is bounded, so it maps to a likeness between 0 and 1.

Defined results: null and empty texts share one digest; texts of fewer than three bytes
have no triplet and differ by checksum and length alone; equal texts have equal digests.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.llm.frames import plain

BUCKETS = 128
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
STEP = np.array([0, 1, 2, 6], dtype=np.int64)
MOST = 6 * BUCKETS + 12 * 8 + 12 * 2 + 1
BLOCK = 1 << 20


def triplet_counts(data: bytes) -> np.ndarray:
    """Counts per bucket, in blocks so that a very long text needs bounded memory."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        block = np.frombuffer(data, np.uint8, count=min(BLOCK + 3, len(data) - at), offset=at).astype(np.uint32)
        for salt, (a, b, c) in enumerate(PATTERNS, 1):
            n = min(BLOCK, len(block) - c)
            if n > 0:
                mixed = block[a : a + n] * np.uint32(0x9E3779B1 * salt & 0xFFFFFFFF)
                mixed ^= block[b : b + n] * np.uint32(0x85EBCA77)
                mixed ^= block[c : c + n] * np.uint32(0xC2B2AE3D)
                mixed *= np.uint32(0x27D4EB2F)
                counts += np.bincount(mixed >> np.uint32(25), minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = triplet_counts(data)
    first, middle, third = np.sort(counts)[[31, 63, 95]]
    codes = (counts > first).astype(np.uint8) + (counts > middle) + (counts > third)
    length = min(255, round(math.log(len(data) + 1) / math.log(1.1)))
    low = int(first * 100 // third) % 16 if third else 0
    high = int(middle * 100 // third) % 16 if third else 0
    four = codes.reshape(-1, 4)
    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    head = bytes([zlib.crc32(data) & 0xFF, length, low << 4 | high])
    return (head + packed.astype(np.uint8).tobytes()).hex()


def _parts(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1)
    codes = (raw[:, 3:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return raw[:, :3].astype(np.int64), codes.reshape(len(prints), -1).astype(np.int64)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 for equal digests, 0 for the largest difference."""
    if not left:
        return np.zeros(0)
    (a, x), (b, y) = _parts(left), _parts(right)
    total = STEP[np.abs(x - y)].sum(axis=1)
    total += np.minimum(np.abs(a[:, 1] - b[:, 1]), 8) * 12
    for shift in (4, 0):
        ring = np.abs((a[:, 2] >> shift & 15) - (b[:, 2] >> shift & 15))
        total += np.minimum(np.minimum(ring, 16 - ring) * 2, 12)
    total += a[:, 0] != b[:, 0]
    return 1.0 - total / MOST


@F.arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([digest(text.as_py()) for text in texts], pa.string())


@F.arrow_udf(T.DoubleType())
def closeness(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(likeness(left.to_pylist(), right.to_pylist()), pa.float64())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with the digest of each text as ``_print``."""
    return plain(docs).withColumn("_print", fingerprint(F.col("text")))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``_next_<column>`` of the following document by id; the first follows the last.

    Ids are cut into ranges by approximate quantiles, one window runs inside each range,
    and the first document of a range is also dealt to the range before it. Only one row
    per range is broadcast. Null ids come last; equal ids are ordered by a hash of the text.
    """
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [n / ranges for n in range(1, ranges)]
    bounds = docs.select(F.percentile_approx("doc_id", shares, 20 * ranges).alias("b")).first()["b"] or []
    bounds = sorted({b for b in bounds if b is not None})
    inner = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    placed = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(inner))
    placed = placed.withColumn("_tie", F.xxhash64("text"))
    heads = placed.groupBy("_range").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_tie").alias("t"))).alias("h")
    )
    order = Window.orderBy("_range")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_range").over(order), F.max("_range").over(whole))
    first = heads.select(F.col("h.i").alias("_hi"), F.col("h.t").alias("_ht"), before.alias("_before"))
    sentinels = (
        placed.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("_hi")) & (F.col("_tie") == F.col("_ht")))
        .withColumn("_range", F.col("_before"))
        .withColumn("_real", F.lit(0))
        .drop("_hi", "_ht", "_before")
    )
    dealt = placed.withColumn("_real", F.lit(1)).unionByName(sentinels)
    ordered = Window.partitionBy("_range").orderBy(F.desc("_real"), F.col("doc_id").asc_nulls_last(), "_tie")
    following = {f"_next_{c}": F.lead(c).over(ordered) for c in columns}
    return dealt.withColumns(following).where(F.col("_real") == 1).drop("_real", "_range", "_tie")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half of code points replaced by the start of the next text."""
    own, other = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(own) / 2).cast("int")
    return F.concat(F.substring(own, F.lit(1), F.length(own) - half), F.substring(other, F.lit(1), half))
