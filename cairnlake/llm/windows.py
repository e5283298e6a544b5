"""Substring dedup over windows of words.

A window is ``length`` consecutive words of one document. Every word covered by a window
whose words also stand earlier (smaller id, or same document, earlier start) is removed.

*Hashes.* Words are hashed, and a Rabin-Karp sum over the word hashes gives the hash of
every window from two prefix sums.

*Dealing.* The least-hashed run of ``GRAM`` words inside a window is its anchor. Equal
windows have equal anchors, and neighbouring windows mostly share theirs, so a row holds
the hashes of all neighbouring windows with one anchor: one shuffle by anchor brings equal
windows together at about a tenth of the rows. A window is known by anchor and hash, 128
bits. The anchors are dealt in ``passes`` parts, one after the other, so that the shuffle
files of only one part lie on disk at a time.

*Counting.* Anchors are counted first; the windows below an anchor of one row cannot
repeat. The others are counted by (anchor, hash), and all places but the first are marked.
Of the texts that a task has at hand, only the first place of a window is shipped; the
others are settled on the spot, so a passage that very many documents share reaches the
shuffle once per slice of text. Anchors of a common line in ever new surroundings, found
as frequent items in a pass of their own, deal their windows one by one.

*Intervals.* Marked windows go back to their document as bit masks per row; there they
merge into maximal intervals of removed words.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null or empty text has no
words; texts of fewer than ``length`` words stay whole; null ids order last; rows with one
id and one text are one document and share their result, rows with one id and different
texts are ordered by a hash of the text; other columns pass through, but for those whose
name starts with an underscore; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.frames import plain
from cairnlake.llm.hashing import BASE, SPACES, U, mix, powers, prefix_hashes, range_hashes
from cairnlake.session import cut_and_free

LENGTH = 20
GRAM = 5
#: Bytes of text that a task hashes and settles at once.
SLICE = 2 << 20
#: Words of one step inside a slice; a longer text is worked off in several.
STEP = 1 << 19
#: Windows of one row, so that the marked ones fit a mask of 64 bits.
ROW = 60
#: An anchor with more than one of ``SHARE`` rows is hot; there are fewer than ``SHARE`` of them at any size.
SHARE = 2000


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every word."""
    inside = ~SPACES[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def sliding_min(values: np.ndarray, reach: int) -> np.ndarray:
    """Least of every ``reach`` neighbours."""
    width = 1
    while 2 * width <= reach:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = reach - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Slice:
    """Documents that are hashed together: ``(id, text hash, UTF-8 text)``, in order of their place."""

    def __init__(self, docs: list[tuple], length: int):
        self.ids = [doc[0] for doc in docs]
        self.texts = np.array([doc[1] for doc in docs], dtype=np.int64)
        self.length = length
        sizes = np.array([len(doc[2]) + 1 for doc in docs])
        self.data = np.frombuffer(b" ".join(doc[2] for doc in docs), np.uint8)
        self.start, self.stop = words_of(self.data)
        self.doc = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        heads = np.searchsorted(self.doc, np.arange(len(docs)))
        self.word = np.arange(len(self.start)) - heads[self.doc]

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(word number in the slice, anchor, hash)`` of every window, step by step."""
        reach = self.length - min(GRAM, self.length) + 1
        for base in range(0, len(self.start) - self.length + 1, STEP):
            last = min(len(self.start), base + STEP + self.length - 1)
            low = self.start[base]
            part = self.data[low : self.stop[last - 1]]
            prefix = prefix_hashes(part)
            words = range_hashes(prefix, self.start[base:last] - low, self.stop[base:last] - low)
            sums = np.zeros(len(words) + 1, dtype=U)
            np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
            at = np.arange(len(words) - self.length + 1)
            grams = np.arange(len(words) - min(GRAM, self.length) + 1)
            anchors = sliding_min(range_hashes(sums, grams, grams + min(GRAM, self.length)), reach)
            inside = self.doc[base + at] == self.doc[base + at + self.length - 1]
            at = at[inside]
            yield at + base, anchors[at], range_hashes(sums, at, at + self.length)

    def batches(self, kind: pa.DataType, part: int, passes: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the windows that are first here, then settled spans."""
        found = list(self.windows())
        if not found:
            return
        at, anchor, window = (np.concatenate(column) for column in zip(*found, strict=True))
        anchor = np.where(np.isin(anchor, hot), mix(anchor ^ window), anchor)
        mine = anchor % U(passes) == U(part)
        at, anchor, window = at[mine], anchor[mine], window[mine]
        order = np.argsort(window, kind="stable")
        again = np.zeros(len(at), dtype=bool)
        again[order[1:]] = (window[order[1:]] == window[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
        yield from self._rows(kind, at[~again], anchor[~again], window[~again])
        yield from self._spans(kind, at[again])

    def _columns(self, kind: pa.DataType, first: np.ndarray) -> list[pa.Array]:
        doc = self.doc[first]
        return [
            pa.array([self.ids[n] for n in doc.tolist()], kind),
            pa.array(self.texts[doc]),
            pa.array(self.word[first].astype(np.int32)),
        ]

    def _heads(self, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Where runs of neighbouring windows of one document begin."""
        new[1:] |= (at[1:] != at[:-1] + 1) | (self.doc[at[1:]] != self.doc[at[:-1]])
        new[:1] = True
        return np.flatnonzero(new)

    def _rows(self, kind: pa.DataType, at: np.ndarray, anchor: np.ndarray, window: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(at), dtype=bool)
        new[1:] = anchor[1:] != anchor[:-1]
        heads = self._heads(at, new)
        lengths = np.diff(heads, append=len(at))
        place = np.arange(len(at)) - np.repeat(heads, lengths)
        heads = np.flatnonzero(place % ROW == 0)
        offsets = np.append(heads, len(at)).astype(np.int32)
        if len(heads):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[heads].view(np.int64)),
                    *self._columns(kind, at[heads]),
                    pa.nulls(len(heads), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(window.view(np.int64))),
                ],
                names=NAMES,
            )

    def _spans(self, kind: pa.DataType, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = self._heads(at, np.zeros(len(at), dtype=bool))
        if len(heads):
            first = at[heads]
            spread = mix(self.texts[self.doc[first]].view(U) + first.astype(U) * U(BASE))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(spread.view(np.int64)),
                    *self._columns(kind, first),
                    pa.array(np.diff(heads, append=len(at)).astype(np.int32)),
                    pa.nulls(len(heads), pa.list_(pa.int64())),
                ],
                names=NAMES,
            )


NAMES = ["_anchor", "_doc", "_text", "_start", "_windows", "_hashes"]
PLACE = ["_doc", "_text"]


def slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Slice]:
    """Distinct documents in order of id and text hash, as many as fit ``SLICE`` bytes."""

    def ordered(held: dict) -> Slice:
        known = sorted(key for key in held if key[0] is not None)
        nameless = sorted((key for key in held if key[0] is None), key=lambda key: key[1])
        return Slice([(*key, held[key]) for key in known + nameless], length)

    held: dict = {}
    size = 0
    for batch in batches:
        for doc, text, data in zip(*batch.columns, strict=True):
            data = data.as_buffer()
            if data is None or len(data) < 2 * length - 1:
                continue
            held[doc.as_py(), text.as_py()] = data.to_pybytes()
            size += len(data) + 1
            if size > SLICE:
                yield ordered(held)
                held, size = {}, 0
    if held:
        yield ordered(held)


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), F.encode("text", "UTF-8").alias("_data")
    )


def hot_anchors(docs: DataFrame, length: int) -> list[int]:
    """Anchors that may hold more than one row in ``1 / SHARE``: a bounded list with some others among them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, length):
            for _, anchor, _ in piece.windows():
                new = np.ones(len(anchor), dtype=bool)
                new[1:] = anchor[1:] != anchor[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64))], names=["_anchor"])

    found = keyed_texts(docs).mapInArrow(scan, "_anchor bigint").freqItems(["_anchor"], 1 / SHARE).first()
    return sorted(set(found[0] or [])) if found else []


def window_rows(docs: DataFrame, length: int, part: int, passes: int, hot: list[int]) -> DataFrame:
    """``(_anchor, _doc, _text, _start, _windows, _hashes)``: hashes of neighbouring windows, or a settled span.

    Windows below a hot anchor are dealt by anchor and hash, one to a row.
    """
    kind = docs.schema["doc_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.array(hot, dtype=np.int64).view(U)
        ahead = next(batches, None)
        if ahead is not None:
            for piece in slices(chain([ahead], batches), length):
                yield from piece.batches(ahead.schema.field(0).type, part, passes, spread)

    schema = f"_anchor bigint, _doc {kind.simpleString()}, _text bigint, _start int, _windows int, _hashes array<bigint>"
    return keyed_texts(docs).mapInArrow(scan, schema)


def marked_windows(rows: DataFrame) -> DataFrame:
    """``(_doc, _text, _start, _windows, _mask)``: windows that also stand earlier, as spans or bit masks."""
    counted = rows.repartition("_anchor").withColumn("_rows", F.count("*").over(Window.partitionBy("_anchor")))
    open_rows = counted.where(F.col("_hashes").isNull() | (F.col("_rows") > 1))
    single = open_rows.select(
        "_anchor", *PLACE, "_start", "_windows", F.posexplode_outer("_hashes").alias("_place", "_hash")
    )
    by_place = Window.partitionBy("_anchor", "_hash").orderBy(
        F.col("_doc").asc_nulls_last(), "_text", F.col("_start") + F.col("_place")
    )
    again = single.withColumn("_rank", F.dense_rank().over(by_place)).where(F.col("_hash").isNull() | (F.col("_rank") > 1))
    return again.groupBy("_anchor", *PLACE, "_start").agg(
        F.max("_windows").alias("_windows"), F.bit_or(F.expr("shiftleft(1L, coalesce(_place, 0))")).alias("_mask")
    ).drop("_anchor")


def removed_words(start: np.ndarray, windows: list, mask: list, words: int, length: int) -> np.ndarray:
    """Flag per word: covered by a marked window."""
    change = np.zeros(words + 1, dtype=np.int64)
    for first, count, bits in zip(start, windows, mask, strict=True):
        if count is not None:
            change[first] += 1
            change[first + count - 1 + length] -= 1
            continue
        while bits:
            low = (bits & -bits).bit_length() - 1
            run = ((bits >> low) + 1 & ~(bits >> low)).bit_length() - 1
            change[first + low] += 1
            change[first + low + run - 1 + length] -= 1
            bits &= ~(((1 << run) - 1) << low)
    return np.cumsum(change[:-1]) > 0


def apply_marks(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_removed``, ``_removed`` (spans of words, end exclusive) and ``_kept``."""
    lists = marks.groupBy(*PLACE).agg(F.collect_list(F.struct("_start", "_windows", "_mask")).alias("_marks"))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    joined = keyed.join(
        lists, keyed["doc_id"].eqNullSafe(lists["_doc"]) & (keyed["_key"] == lists["_text"]), "left"
    ).drop("_doc", "_text", "_key")
    result = "_n_words bigint, _n_removed bigint, _removed array<struct<start:int,stop:int>>, _kept string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield cut_batch(whole.slice(at, 256), length)

    kept = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    return joined.mapInArrow(cut, f"{kept}, {result}")


def cut_batch(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    counts, gone, spans, texts = [], [], [], []
    marks = batch.column(batch.schema.get_field_index("_marks"))
    for text, listed in zip(batch.column(batch.schema.get_field_index("text")), marks, strict=True):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        start, stop = words_of(np.frombuffer(data, np.uint8))
        away = np.zeros(len(start), dtype=bool)
        if listed.is_valid:
            fields = listed.values.flatten()
            away = removed_words(*[field.to_pylist() for field in fields], len(start), length)
        edges = np.flatnonzero(np.diff(away.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        stays = np.flatnonzero(~away)
        counts.append(len(start))
        gone.append(len(start) - len(stays))
        spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        texts.append(b" ".join(data[a:b] for a, b in zip(start[stays].tolist(), stop[stays].tolist(), strict=True)).decode())
    passed = [name for name in batch.schema.names if name != "_marks"]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index(name)) for name in passed]
        + [
            pa.array(counts, pa.int64()),
            pa.array(gone, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            pa.array(texts, pa.string()),
        ],
        names=[*passed, "_n_words", "_n_removed", "_removed", "_kept"],
    )


def dedup_windows(docs: DataFrame, length: int = LENGTH, passes: int = 2) -> DataFrame:
    """``docs`` with ``_kept`` (the words that stay, joined by a space), ``_removed`` spans and word counts."""
    docs = plain(docs)
    narrow = docs.select("doc_id", "text")
    hot = hot_anchors(narrow, length)
    parts = [cut_and_free(marked_windows(window_rows(narrow, length, part, passes, hot))) for part in range(passes)]
    return apply_marks(docs, reduce(DataFrame.unionByName, parts), length)
