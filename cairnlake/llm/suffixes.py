"""Suffix-array dedup of long repeated byte strings.

Every byte covered by a string of ``length`` bytes that also starts earlier is removed.

*Candidates.* All windows of ``length`` bytes whose least-hashed gram of ``GRAM`` bytes is
the same occurrence form a block. Equal windows have equal grams at equal offsets, so a
window can repeat only where its block's gram repeats. Blocks equal to an earlier block are
removed whole; blocks that share a gram but differ go into the suffix array.

*Suffix array.* Positions lie on a lattice of ``SYMBOL`` bytes counted from the gram, so
windows that can be equal keep their place on it. Of the lattice indices, those of the
difference cover {1, 2} modulo 3 are the sample: their symbol triples are sorted over the
cluster and named by rank; triples of names are sorted and named again, which orders
sample suffixes to nine symbols, more than a window. Suffixes at index 0 modulo 3 are
merged in by their first symbol and the rank of the suffix behind it.

*Comparison.* In suffix order, runs of neighbours with long common prefixes hold all equal
windows. The windows that start up to ``SYMBOL - 1`` bytes before a suffix are compared by
common prefix and the bytes before it; all but the earliest of a class are removed. Runs
that touch the edge of a partition or exceed ``RUN_ROWS`` rows are settled by a combined
minimum per window instead, so equal suffixes may spread over many tasks.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` stay
whole; null ids order last; rows with one id and one text are one document and share
their result, rows with one id and different texts are ordered by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.frames import plain
from cairnlake.llm.hashing import U, gram_hashes, mix, prefix_hashes, range_hashes
from cairnlake.session import cut_lineage, free_shuffles

LENGTH = 100
GRAM = 32
SYMBOL = 16
SLICE = 1 << 20
FLUSH = 4 << 20
JOINED = 1 << 16
RUN_ROWS = 1 << 16
LAST = (1 << 63) - 1
TEXT = ["_doc", "_hash", "_tag"]
WHERE = ["_doc", "_hash", "_pack"]
PLACE_BITS = U((1 << 20) - 1)


def packed(tag: np.ndarray, start: np.ndarray, lead: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Text tag, first window, distance of the gram and number of windows in one ordered number."""
    return tag << 45 | start << 14 | lead << 7 | windows


def unpacked(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return pack >> 45, pack >> 14 & 0x7FFFFFFF, pack >> 7 & 127, pack & 127


def anchors(prefix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for every window the place of its least-hashed one."""
    reach = length - GRAM + 1
    grams = gram_hashes(prefix, GRAM)
    # The last grams of a full slice lie beyond 2**20: places then take one bit more of the hash.
    mask = PLACE_BITS if len(grams) <= 1 << 20 else (PLACE_BITS << U(1)) | U(1)
    least = grams & ~mask
    least |= np.arange(len(grams), dtype=U)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    return grams, (least & mask).astype(np.int64)


def blocks_of(data: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """``(gram hash, block hash, first window, lead, windows)`` of all blocks, slice by slice."""
    for base in range(0, max(0, len(data) - length + 1), SLICE):
        yield blocks_of_texts([data[base : base + SLICE + length - 1]], length, base)[:-1]


def blocks_of_texts(texts: list[np.ndarray], length: int = LENGTH, base: int = 0) -> tuple[np.ndarray, ...]:
    """``(gram hash, block hash, first window, lead, windows, text number)`` of all blocks of some texts at once.

    They are laid end to end; windows that reach from one into the next are left out.
    """
    data = texts[0] if len(texts) == 1 else np.concatenate(texts)
    ends = np.cumsum([len(text) for text in texts])
    if len(data) < length:
        return (*(np.zeros(0, U),) * 2, *(np.zeros(0, np.int64),) * 4)
    grams, anchor = anchors(prefix_hashes(data, 1), length)
    inside = np.ones(len(anchor), dtype=bool)
    for begin, stop in zip((ends - length + 1).tolist(), ends.tolist(), strict=True):
        inside[max(0, begin) : stop] = False
    start = np.flatnonzero(inside)
    anchor = anchor[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    first, anchor, windows = start[head], anchor[head], np.diff(head, append=len(start))
    hashes = range_hashes(prefix_hashes(data, 2), first, first + windows + length - 1)
    lead, number = anchor - first, np.searchsorted(ends, first, side="right")
    begins = np.append(0, ends[:-1])
    return grams[anchor], hashes ^ (lead.astype(U) * U(0x9E3779B97F4A7C15)), first - begins[number] + base, lead, windows, number


def _runs(flags: np.ndarray) -> np.ndarray:
    return np.cumsum(flags) - 1


def joined(sizes: np.ndarray) -> Iterator[list[int]]:
    """Numbers of neighbouring texts that together have few bytes; a long text stays alone."""
    rows, held = [], 0
    for row, size in enumerate(sizes.tolist()):
        if rows and held + size > JOINED:
            yield rows
            rows, held = [], 0
        rows.append(row)
        held += size
    if rows:
        yield rows


def find_blocks(docs: DataFrame, length: int) -> DataFrame:
    """``(_gram, _block, _doc, _hash, _pack, _until)`` of all blocks.

    Among the texts that a task has at hand, blocks equal to an earlier one come out as
    removed spans already (``_until`` set, neighbours joined), so that a block which very
    many documents share reaches the shuffle once per batch.
    """

    def batch_rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, block, doc, text, pack = (np.concatenate(column) for column in zip(*parts, strict=True))
        # Only blocks that share a hash with another one are sorted in full.
        both = gram ^ mix(block)
        order = np.argsort(both)
        equal = both[order[1:]] == both[order[:-1]]
        shared = np.append(False, equal)
        shared[:-1] |= equal
        order = order[shared]
        order = order[np.lexsort(tuple(x[order] for x in (pack, text, doc, block, gram)))]
        same = np.zeros(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        same[1:] = (gram[a] == gram[b]) & (block[a] == block[b])
        # Repeated rows give the same block of the same document once more; that is no copy.
        again = np.zeros(len(order), dtype=bool)
        again[1:] = same[1:] & (doc[a] == doc[b]) & (text[a] == text[b]) & (pack[a] == pack[b])
        copy = np.zeros(len(gram), dtype=bool)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        first = order[head]
        copy[order] = same & ~((doc[order] == doc[first]) & (text[order] == text[first]) & (pack[order] == pack[first]))
        drop = np.zeros(len(gram), dtype=bool)
        drop[order] = again
        keep = ~copy & ~drop
        gone = np.flatnonzero(copy & ~drop)
        tag, start, _, windows = unpacked(pack[gone])
        by = np.lexsort((start, tag, text[gone], doc[gone]))
        gone, tag, start, stop = gone[by], tag[by], start[by], (start + windows)[by]
        new = np.ones(len(gone), dtype=bool)
        new[1:] = (doc[gone[1:]] != doc[gone[:-1]]) | (text[gone[1:]] != text[gone[:-1]]) | (tag[1:] != tag[:-1]) | (start[1:] != stop[:-1])
        heads = np.flatnonzero(new)
        ends = stop[np.append(heads[1:], len(gone)) - 1] + length - 1 if len(gone) else stop
        n, m = int(keep.sum()), len(heads)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([gram[keep].view(np.int64), block[gone[heads]].view(np.int64)])),
                pa.array(np.concatenate([block[keep].view(np.int64), np.zeros(m, np.int64)])),
                pa.array(np.concatenate([doc[keep], doc[gone[heads]]])),
                pa.array(np.concatenate([text[keep], text[gone[heads]]])),
                pa.array(np.concatenate([pack[keep], pack[gone[heads]]])),
                pa.array(np.concatenate([np.zeros(n, np.int32), ends.astype(np.int32)])),
            ],
            names=["_gram", "_block", "_doc", "_hash", "_pack", "_until"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            docs_of, texts_of, tags = (batch.column(n).to_numpy().astype(np.int64) for n in TEXT)
            contents = [np.frombuffer(x.as_buffer() or b"", np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in batch.column("_data")]
            sizes = np.array([len(content) for content in contents])
            for rows in joined(sizes):
                if len(rows) == 1:
                    found = [(*blocks, np.zeros(len(blocks[0]), np.int64)) for blocks in blocks_of(contents[rows[0]], length)]
                else:
                    found = [blocks_of_texts([contents[row] for row in rows], length)]
                for gram, block, start, lead, windows, number in found:
                    if not len(gram):
                        continue
                    row = np.array(rows)[number]
                    parts.append((gram, block, docs_of[row], texts_of[row], packed(tags[row], start, lead, windows)))
                held += int(sizes[rows].sum())
                if held >= FLUSH and parts:
                    yield batch_rows(parts)
                    parts, held = [], 0
        if parts:
            yield batch_rows(parts)

    return docs.select(*TEXT, "_data").mapInArrow(scan, "_gram bigint, _block bigint, _doc bigint, _hash bigint, _pack bigint, _until int")


def sort_blocks(blocks: DataFrame, length: int) -> DataFrame:
    """``(_doc, _hash, _pack, _until)``: removed spans (``_until`` set), and blocks with a variant (``_until`` 0).

    Blocks meet by gram in sorted partitions and are read as a stream: the first row of a
    class is its earliest document. Spans that are settled already are dealt by document and
    lie between them; they pass through.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int, int, int] | None = None
        waiting: tuple[int, int, int] | None = None
        several = False
        for batch in batches:
            gram, block, doc, text, pack, until = (batch.column(n).to_numpy() for n in ("_gram", "_block", *WHERE, "_until"))
            out = [(doc[until > 0], text[until > 0], pack[until > 0], until[until > 0])]
            live = np.flatnonzero(until == 0)
            if len(live):
                gram, block, doc, text, pack = gram[live], block[live], doc[live], text[live], pack[live]
                new_gram, new_class = np.ones(len(gram), bool), np.ones(len(gram), bool)
                new_gram[1:] = gram[1:] != gram[:-1]
                new_class[1:] = new_gram[1:] | (block[1:] != block[:-1])
                new_place = np.ones(len(gram), bool)
                new_place[1:] = new_class[1:] | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (pack[1:] != pack[:-1])
                if last is not None:
                    new_gram[0] = gram[0] != last[0]
                    new_class[0] = new_gram[0] or block[0] != last[1]
                    new_place[0] = new_class[0] or (doc[0], text[0], pack[0]) != last[2:]
                copies = ~new_class & new_place
                # A repeated row of the first place of a class is no copy of itself.
                tag, start, _, windows = unpacked(pack[copies])
                out.append((doc[copies], text[copies], pack[copies], (start + windows + length - 1).astype(np.int32)))
                group = _runs(new_gram) + (0 if new_gram[0] else 1)
                classes = np.bincount(group[new_class], minlength=group[-1] + 1)
                heads = np.flatnonzero(new_class)
                if not new_gram[0] and new_class[0] or (not new_gram[0] and classes[0]):
                    if waiting is not None:
                        out.append((*(np.array([x]) for x in waiting), np.zeros(1, np.int32)))
                        waiting = None
                    several = True
                varied = classes[group[heads]] > 1
                if not new_gram[0]:
                    varied |= (group[heads] == 0) & several
                # The last gram may go on in the next batch: its only class waits.
                tail = group[heads] == group[-1]
                emit = varied.copy()
                out.append((doc[heads[emit]], text[heads[emit]], pack[heads[emit]], np.zeros(int(emit.sum()), np.int32)))
                fresh = group[-1] > 0 or bool(new_gram[0])
                if fresh:
                    held = heads[tail & ~varied]
                    several = not len(held)
                    waiting = (int(doc[held[0]]), int(text[held[0]]), int(pack[held[0]])) if len(held) else None
                last = (int(gram[-1]), int(block[-1]), int(doc[-1]), int(text[-1]), int(pack[-1]))
            *places, until_out = (np.concatenate(column) for column in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, places), pa.array(until_out.astype(np.int32))], names=[*WHERE, "_until"]
            )

    settled = F.col("_until") > 0
    key = F.when(settled, F.xxhash64(*WHERE)).otherwise(F.col("_gram"))
    return (
        blocks.repartition(key)
        .sortWithinPartitions("_gram", "_block", *WHERE)
        .mapInArrow(stream, "_doc bigint, _hash bigint, _pack bigint, _until int")
    )


def starts_of(lead: int, windows: int) -> range:
    """Lattice offsets in a block at or just behind its windows."""
    return range(lead % SYMBOL, windows + SYMBOL - 1, SYMBOL)


def sampled(offset: int, lead: int) -> int:
    """The sample offset that ranks a suffix: itself, or the next one at index 0 modulo 3."""
    return offset if (offset - lead) // SYMBOL % 3 else offset + SYMBOL


def named(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """``kept`` columns with ``_name``, the rank of the keys over the whole table.

    Rows are range-partitioned and sorted by the keys; a name is the number of the
    partition followed by the rank inside it, so names order as the keys do.
    """
    kinds = dict(rows.dtypes)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() + 1) << 40
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            for column in columns:
                if pa.types.is_binary(column.type):
                    values = np.array(column.to_pylist(), dtype=object)
                else:
                    values = column.to_numpy()
                new[1:] |= values[1:] != values[:-1]
            head = tuple(column[0].as_py() for column in columns)
            new[0] = head != last
            ranks = count + np.cumsum(new)
            count = int(ranks[-1])
            last = tuple(column[-1].as_py() for column in columns)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(base + ranks)], names=[*kept, "_name"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in kept) + ", _name bigint"
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(rank, schema)


def sample_triples(variants: DataFrame) -> DataFrame:
    """``(_doc, _hash, _pack, _offset, _base, _triple)``: three symbols at every sample position needed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rows, offsets, bases, triples = [], [], [], []
                _, _, leads, windows = unpacked(batch.column("_pack").to_numpy())
                for number, (lead, count, data) in enumerate(zip(leads, windows, batch.column("_bytes").to_pylist(), strict=True)):
                    based = {sampled(o, lead) for o in starts_of(int(lead), int(count))}
                    needed = {b + step * SYMBOL for b in based for step in (0, 3, 6)}
                    for offset in needed:
                        if offset < len(data):
                            rows.append(number)
                            offsets.append(offset)
                            bases.append(offset in based)
                            triples.append(data[offset : offset + 3 * SYMBOL])
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(n).take(index) for n in WHERE],
                        pa.array(offsets, pa.int32()),
                        pa.array(bases, pa.bool_()),
                        pa.array(triples, pa.binary()),
                    ],
                    names=[*WHERE, "_offset", "_base", "_triple"],
                )

    return variants.mapInArrow(cut, "_doc bigint, _hash bigint, _pack bigint, _offset int, _base boolean, _triple binary")


def name_triples(names: DataFrame) -> DataFrame:
    """``(_doc, _hash, _pack, _offset, _n0, _n1, _n2)``: the names three, and six, indices on; 0 behind the end."""
    listed = names.groupBy(*WHERE).agg(F.collect_list(F.struct("_offset", "_base", "_name")).alias("_all"))
    by_offset = listed.withColumn(
        "_map", F.map_from_entries(F.transform("_all", lambda x: F.struct(x["_offset"], x["_name"])))
    )

    def later(x, step: int):
        return F.coalesce(F.try_element_at("_map", x["_offset"] + step * SYMBOL), F.lit(0).cast("long"))

    triples = F.transform(
        F.filter("_all", lambda x: x["_base"]),
        lambda x: F.struct(
            x["_offset"].alias("_offset"), x["_name"].alias("_n0"), later(x, 3).alias("_n1"), later(x, 6).alias("_n2")
        ),
    )
    return by_offset.select(*WHERE, F.explode(triples).alias("_t")).select(*WHERE, "_t.*")


def suffix_rows(variants: DataFrame, ranks: DataFrame, length: int) -> DataFrame:
    """One row per suffix with its sort key ``(_rest, _symbol, _name)`` and the bytes around it."""
    listed = ranks.groupBy(*WHERE).agg(F.map_from_entries(F.collect_list(F.struct("_offset", "_name"))).alias("_ranks"))
    joined = variants.join(listed, WHERE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rows, rest, symbols, names, offsets, texts = [], [], [], [], [], []
                _, _, leads, windows = unpacked(batch.column("_pack").to_numpy())
                values = zip(leads, windows, batch.column("_bytes").to_pylist(), batch.column("_ranks").to_pylist(), strict=True)
                for number, (lead, count, data, ranked) in enumerate(values):
                    ranked = dict(ranked)
                    for offset in starts_of(int(lead), int(count)):
                        at_sample = sampled(offset, lead)
                        rows.append(number)
                        rest.append((offset - int(lead)) // SYMBOL % 3)
                        symbols.append(b"" if at_sample == offset else data[offset : offset + SYMBOL])
                        names.append(ranked.get(at_sample, 0))
                        offsets.append(offset)
                        texts.append(data[max(0, offset - SYMBOL + 1) : offset + length])
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rest, pa.int32()),
                        pa.array(symbols, pa.binary()),
                        pa.array(names, pa.int64()),
                        *[batch.column(n).take(index) for n in WHERE],
                        pa.array(offsets, pa.int32()),
                        pa.array(texts, pa.binary()),
                    ],
                    names=["_rest", "_symbol", "_name", *WHERE, "_offset", "_text"],
                )

    return joined.mapInArrow(
        build, "_rest int, _symbol binary, _name bigint, _doc bigint, _hash bigint, _pack bigint, _offset int, _text binary"
    )


class SuffixChunk:
    """Neighbouring suffixes of one sorted partition as arrays."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        self.rest = table.column("_rest").to_numpy()
        self.doc, self.offset = table.column("_doc").to_numpy(), table.column("_offset").to_numpy().astype(np.int64)
        self.hash = table.column("_hash").to_numpy()
        self.tag, self.start, _, self.windows = unpacked(table.column("_pack").to_numpy())
        texts = table.column("_text").to_pylist()
        self.before = np.minimum(self.offset, SYMBOL - 1)
        n = len(texts)
        self.bytes = np.zeros((n, SYMBOL - 1 + length), dtype=np.uint8)
        self.size = np.zeros(n, dtype=np.int64)
        for row, (text, before) in enumerate(zip(texts, self.before, strict=True)):
            shift = SYMBOL - 1 - int(before)
            self.bytes[row, shift : shift + len(text)] = np.frombuffer(text, np.uint8)
            self.size[row] = len(text) - before
        self.prefix = self.common_prefixes()

    def common_prefixes(self) -> np.ndarray:
        """Common prefix of each suffix with the one before it; 0 for the first."""
        suffix = self.bytes[:, SYMBOL - 1 :]
        shared = np.zeros(len(suffix), dtype=np.int64)
        if len(suffix) > 1:
            differs = suffix[1:] != suffix[:-1]
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), self.length)
            shared[1:] = np.minimum(first, np.minimum(self.size[1:], self.size[:-1]))
            shared[1:][self.rest[1:] != self.rest[:-1]] = 0
        return shared

    def run_heads(self) -> np.ndarray:
        """First rows of runs outside which no window is shared."""
        return np.flatnonzero(self.prefix < self.length - SYMBOL + 1)

    def window(self, back: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that own a window starting ``back`` bytes before their suffix, and its place in the block."""
        at = self.offset - back
        rows = np.flatnonzero((at >= 0) & (at < self.windows))
        return rows, at[rows]

    def repeated(self) -> tuple[np.ndarray, ...]:
        """``(doc, hash, tag, from, to)`` of the windows that an earlier one equals."""
        found = []
        for back in range(SYMBOL):
            rows, at = self.window(back)
            if not len(rows):
                continue
            segment = np.cumsum(self.prefix < self.length - back)[rows]
            head = np.zeros((len(rows), 16), dtype=np.uint8)
            head[:, :back] = self.bytes[rows, SYMBOL - 1 - back : SYMBOL - 1]
            high, low = head.view(np.uint64).T
            doc, text, place = self.doc[rows], self.hash[rows], self.tag[rows] << 31 | (self.start[rows] + at)
            order = np.lexsort((place, text, doc, low, high, segment))
            a, b = order[1:], order[:-1]
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (segment[a] == segment[b]) & (high[a] == high[b]) & (low[a] == low[b])
            first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            gone = order[same & ((doc[order] != doc[first]) | (text[order] != text[first]) | (place[order] != place[first]))]
            begin = self.start[rows[gone]] + at[gone]
            found.append((doc[gone], text[gone], self.tag[rows[gone]], begin, begin + self.length))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5

    def all_windows(self) -> tuple[np.ndarray | list[bytes], ...]:
        """``(doc, hash, tag, from, to, bytes)`` of every window of the chunk."""
        found, contents = [], []
        for back in range(SYMBOL):
            rows, at = self.window(back)
            begin = self.start[rows] + at
            found.append((self.doc[rows], self.hash[rows], self.tag[rows], begin, begin + self.length))
            left = SYMBOL - 1 - back
            contents += [self.bytes[row, left : left + self.length].tobytes() for row in rows]
        return (*(np.concatenate(c) for c in zip(*found, strict=True)), contents)


SPAN_COLUMNS = [*TEXT, "_from", "_to"]
SPAN_NAMES = [*SPAN_COLUMNS, "_window"]
SPAN_TYPES = "_doc bigint, _hash bigint, _tag int, _from int, _to int, _window binary"


def span_batch(spans: tuple, contents: list[bytes] | None = None) -> pa.RecordBatch:
    doc, text, tag, begin, stop = spans[:5]
    windows = pa.array(contents, pa.binary()) if contents is not None else pa.nulls(len(doc), pa.binary())
    numbers = [pa.array(x.astype(np.int32)) for x in (tag, begin, stop)]
    keys = [pa.array(x.astype(np.int64)) for x in (doc, text)]
    return pa.RecordBatch.from_arrays([*keys, *numbers, windows], names=SPAN_NAMES)


def join_spans(spans: tuple) -> tuple:
    """Overlapping spans of one document as one."""
    if not len(spans[0]):
        return spans
    doc, text, tag, begin, _ = spans
    order = np.lexsort((begin, tag, text, doc))
    doc, text, tag, begin, stop = (x[order] for x in spans)
    new = np.ones(len(doc), dtype=bool)
    # Windows have one length, so sorted starts have sorted ends.
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (tag[1:] != tag[:-1]) | (begin[1:] > stop[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], text[heads], tag[heads], begin[heads], stop[np.append(heads[1:], len(doc)) - 1]


def compare_neighbours(ordered: DataFrame, length: int, run_rows: int) -> DataFrame:
    """Repeated windows as spans; windows of open runs with their bytes."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        opened = True  # the run at the head of ``held`` may begin in the partition before
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = pa.Table.from_batches([batch.slice(at, 8192)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows < 8192:
                    continue
                chunk = SuffixChunk(held, length)
                heads = chunk.run_heads()
                first = heads[heads > 0][:1]
                if opened and len(first):
                    yield from self_windows(held.slice(0, int(first[0])), length)
                    held, opened = held.slice(int(first[0])), False
                    chunk = SuffixChunk(held, length)
                    heads = chunk.run_heads()
                if not opened and len(heads) > 1:
                    cut = int(heads[-1])
                    yield span_batch(join_spans(SuffixChunk(held.slice(0, cut), length).repeated()))
                    held = held.slice(cut)
                if held.num_rows > run_rows:
                    yield from self_windows(held.slice(0, held.num_rows - 1), length)
                    held, opened = held.slice(held.num_rows - 1), True
        if held is not None and held.num_rows:
            heads = SuffixChunk(held, length).run_heads()
            head = int(next(iter(heads[heads > 0]), held.num_rows)) if opened else 0
            tail = max(head, int(heads[-1]))
            if head:
                yield from self_windows(held.slice(0, head), length)
            if tail > head:
                yield span_batch(join_spans(SuffixChunk(held.slice(head, tail - head), length).repeated()))
            if held.num_rows > tail:
                yield from self_windows(held.slice(tail), length)

    def self_windows(table: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, table.num_rows, 2048):
            *spans, contents = SuffixChunk(table.slice(at, 2048), size).all_windows()
            yield span_batch(tuple(spans), contents)

    return ordered.mapInArrow(stream, SPAN_TYPES)


def repeated_spans(docs: DataFrame, length: int = LENGTH, run_rows: int = RUN_ROWS) -> DataFrame:
    """``(_doc, _hash, _tag, _from, _to)``: spans of removed bytes, possibly overlapping."""
    spark = docs.sparkSession
    settled = cut_lineage(sort_blocks(find_blocks(docs, length), length))
    free_shuffles(spark)
    start = F.col("_pack").bitwiseAND(0x7FFFFFFF << 14) / F.lit(1 << 14)
    whole = settled.where("_until > 0").select(
        "_doc", "_hash", F.shiftright("_pack", 45).cast("int").alias("_tag"), start.cast("int").alias("_from"), F.col("_until").alias("_to")
    )
    wanted = settled.where("_until = 0").withColumn("_tag", F.shiftright("_pack", 45).cast("int"))
    per_text = wanted.groupBy(*TEXT).agg(F.collect_set("_pack").alias("_packs"))
    texts = docs.select(*TEXT, "_data").join(per_text, TEXT).select("_doc", "_hash", "_data", "_packs")
    begin = F.shiftright("_pack", 14).bitwiseAND(0x7FFFFFFF).cast("int")
    size = F.col("_pack").bitwiseAND(127).cast("int") + (length - 1)
    variants = cut_lineage(
        texts.select("_doc", "_hash", "_data", F.explode("_packs").alias("_pack"))
        .select(*WHERE, F.substring("_data", begin + 1, size).alias("_bytes"))
        .dropDuplicates(WHERE)
    )
    free_shuffles(spark)
    triples = named(sample_triples(variants), ["_triple"], [*WHERE, "_offset", "_base"])
    ranks = cut_lineage(named(name_triples(triples), ["_n0", "_n1", "_n2"], [*WHERE, "_offset"]))
    free_shuffles(spark)
    order = ["_rest", "_symbol", "_name", *WHERE, "_offset"]
    ordered = suffix_rows(variants, ranks, length).repartitionByRange(*order).sortWithinPartitions(*order)
    compared = cut_lineage(compare_neighbours(ordered, length, run_rows))
    free_shuffles(spark)
    windows = compared.where(F.col("_window").isNotNull())
    place = F.struct(*TEXT, "_from")
    earliest = windows.groupBy("_window").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first <> _last")
    opened = windows.join(earliest, "_window").where(place != F.col("_first")).select(*SPAN_COLUMNS)
    closed = compared.where(F.col("_window").isNull()).select(*SPAN_COLUMNS)
    return whole.unionByName(closed).unionByName(opened)


def with_places(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_doc`` (ordering key), ``_hash`` and ``_tag`` (64 and 16 bits of the text's MD5), ``_data`` (its bytes).

    Texts of one id, or without one, are told apart by all 80 bits: among a billion of them
    two collide with a probability of 4e-7.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.withColumns(
        {
            "_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)),
            "_hash": F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"),
            "_tag": F.conv(F.substring(digest, 17, 4), 16, 10).cast("int"),
            "_data": F.coalesce("text", F.lit("")).cast("binary"),
        }
    )


def dedup_repeats(docs: DataFrame, length: int = LENGTH, run_rows: int = RUN_ROWS) -> DataFrame:
    """``docs`` with ``_kept`` (bytes left), ``_n_bytes``, ``_n_removed``, and ``_removed`` (spans, end exclusive)."""
    placed = with_places(plain(docs))
    narrow = with_places(docs.select("doc_id", "text")).select(*TEXT, "_data")
    spans = repeated_spans(narrow, length, run_rows)
    listed = spans.groupBy(*TEXT).agg(F.collect_set(F.struct("_from", "_to")).alias("_spans"))

    @F.arrow_udf("struct<kept:binary,removed:array<struct<start:int,stop:int>>>")
    def remove(data: pa.Array, found: pa.Array) -> pa.Array:
        kept, removed = [], []
        for content, spans_of in zip(data, found, strict=True):
            joined: list[list[int]] = []
            if spans_of.is_valid:
                for span in sorted((s["_from"], s["_to"]) for s in spans_of.as_py()):
                    if joined and span[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], span[1])
                    else:
                        joined.append(list(span))
            raw, at, parts = content.as_py(), 0, []
            for begin, stop in joined:
                parts.append(raw[at:begin])
                at = stop
            kept.append(b"".join([*parts, raw[at:]]))
            removed.append([{"start": b, "stop": s} for b, s in joined])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, kind)], ["kept", "removed"])

    return (
        placed.join(listed, TEXT, "left")
        .withColumn("_result", remove("_data", "_spans"))
        .withColumn("_kept", F.col("_result.kept"))
        .withColumn("_removed", F.col("_result.removed"))
        .withColumn("_n_bytes", F.length("_data").cast("long"))
        .withColumn("_n_removed", F.col("_n_bytes") - F.length("_kept"))
        .drop(*TEXT, "_data", "_spans", "_result")
    )
