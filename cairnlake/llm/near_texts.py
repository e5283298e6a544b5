"""MinHash near-dedup with weighted signatures (BagMinHash).

A text is the multiset of its five-word shingles. Every shingle owns, for each dyadic
interval of weights ``[0,1) [1,2) [2,4) ...``, a Poisson process over time: its points carry
a signature place and a position in the interval, and count where the position lies below
the shingle's number of occurrences. Per place the earliest point of all shingles wins, so
two texts agree in a place with a probability equal to their weighted Jaccard similarity.
Processes run only up to a time by which all places are expected to be filled.

Signatures are cut into bands. Documents that share a band are candidates: each is first
paired with the center of the bucket, its member that shares most buckets with others, as
an original does with its edited copies. Such a pair is verified by exact multiset overlap
unless the sizes of the texts, or 512 bits of their signatures, rule it out: a pair at the
required similarity differs by more bits than the limit of five standard deviations with a
probability of 3e-7. Rows of one bucket that then still lie in different components are
open; the shingles that a text shares with no other open text bound its overlap with any
partner, which closes most texts exactly. The open rows of all buckets of a center are
compared in blocks: a task holds some strays by their shingles, streams other rows past
them and counts the exact overlap with all at once, so every link between candidates that
could join two components is found and no pair becomes a row. Work inside a group of
differently edited copies stays quadratic in its open rows.

Texts with the same words are one node. Hot buckets are counted and their centers chosen by
combined aggregates, verification salts documents with many partners, and no bucket is
gathered. With 64 bands of 8 places a pair at similarity 0.8 is missed with probability
below 1e-5, one above 0.85 below 2e-9.

Defined results: null texts and texts without a word form no group; a text of fewer words
than a shingle has one shingle; rows with a null id link with nothing; rows with one id are
one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.components import components
from cairnlake.llm.frames import plain
from cairnlake.llm.hashing import U, mix, shingles, shingles_of, word_hashes, words_of
from cairnlake.session import cut_lineage

SHINGLE = 5
BANDS = 64
PLACES = 8
PARTNERS = 256
SALTS = 16
BLOCK_ROWS = 1 << 10
BLOCK_SHINGLES = 1 << 19
BITS = 512
WORDS = [f"_b{n}" for n in range(BITS // 64)]
CELLS = 1 << 14
FINE = 2
TEXTS_AT_ONCE = 512
CHARS_AT_ONCE = 2 << 20
STEP = 0x9E3779B97F4A7C15


def intervals(counts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Level, bounds and rows of every dyadic weight interval that some count reaches into."""
    level, low, high = 0, 0, 1
    while (rows := np.flatnonzero(counts > low)).size:
        yield level, low, high, rows
        level, low, high = level + 1, high, high * 2


def draw(keys: np.ndarray, last: np.ndarray, rate: np.ndarray | float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks and times of the next ``width`` points of processes that stand at ``last``; a row per point."""
    marks = mix((np.arange(1, width + 1, dtype=U) * U(STEP))[:, None] + keys)
    times = (marks >> U(11)).astype(np.float64)
    times += 1
    times /= float(1 << 53)
    np.log(times, out=times)
    times /= -rate
    times[0] += last
    # Times grow by sequential sums, so they do not depend on how many points are drawn at once.
    return marks, np.cumsum(times, axis=0, out=times)


def under(marks: np.ndarray, low: np.ndarray | float, rate: np.ndarray | float, counts: np.ndarray) -> np.ndarray:
    """Whether points lie below the counts."""
    return low + rate * (mix(marks ^ U(0xA24BAED4963EE407)) >> U(11)).astype(np.float64) / float(1 << 53) < counts


def place_of(marks: np.ndarray, places: int) -> np.ndarray:
    return (((marks & U(0xFFFFFFFF)) * U(places)) >> U(32)).astype(np.int64)


def points(
    keys: np.ndarray, counts: np.ndarray, low: int, high: int, until: float, places: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(place, time, mark)`` of the points up to ``until`` below the counts."""
    rate, last = float(high - low), np.zeros(len(keys))
    while len(keys):
        width = max(1, min(int(rate * until), (1 << 20) // len(keys)))
        marks, times = draw(keys, last, rate, width)
        chosen = (times <= until) & under(marks, low, rate, counts)
        yield place_of(marks[chosen], places), times[chosen], marks[chosen]
        on = times[-1] <= until
        keys, counts, last = keys[on] + U(width * STEP % (1 << 64)), counts[on], times[-1][on]


def signatures(values: np.ndarray, counts: np.ndarray, owner: np.ndarray, places: int = BANDS * PLACES) -> np.ndarray:
    """Mark of the earliest point per place, a row per multiset; ``owner`` numbers the multisets from 0, none is empty.

    The processes of a multiset are drawn up to a common time, which grows until every
    place has a point up to it: no later point can come first anywhere. Processes of all
    multisets that have about as many points to go are drawn at once.
    """
    totals = np.bincount(owner, counts)
    found = [
        (mix(values[rows] + U(level * 0x632BE59BD9B4E019 % (1 << 64))), owner[rows], counts[rows], np.full(len(rows), low), np.full(len(rows), high))
        for level, low, high, rows in intervals(counts)
    ]
    until = places * np.log(places + 1) / totals
    keys, owner, counts, low, high = (np.concatenate(column) for column in zip(*found, strict=True))
    rate, partial, last = (high - low).astype(np.float64), counts < high, np.zeros(len(keys))
    first, signed = np.full(len(totals) * places, np.inf), np.zeros(len(totals) * places, dtype=U)
    on = np.arange(len(keys))
    while len(on):
        ahead = rate[on] * (until[owner[on]] - last[on])
        width = ahead + np.sqrt(ahead) / 2 + 1
        # Classes of like width, those with points to judge by their height apart.
        kind = (np.ceil(np.log2(width) * FINE) * 2 + partial[on]).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        on, kind = on[order], kind[order]
        heads = np.flatnonzero(np.diff(kind, prepend=-1))
        for head, stop in zip(heads, np.append(heads[1:], len(on)), strict=True):
            wide = min(int(2 ** (kind[head] // 2 / FINE)), CELLS)
            step = max(1, CELLS // wide)
            for at in range(head, stop, step):
                rows = on[at : min(at + step, stop)]
                marks, times = draw(keys[rows], last[rows], rate[rows], wide)
                spots = place_of(marks, places) + owner[rows] * places
                keys[rows] += U(wide * STEP % (1 << 64))
                last[rows] = times[-1]
                if kind[head] % 2:
                    chosen = under(marks, low[rows], rate[rows], counts[rows])
                    marks, times, spots = marks[chosen], times[chosen], spots[chosen]
                marks, times, spots = marks.ravel(), times.ravel(), spots.ravel()
                np.minimum.at(first, spots, times)
                best = np.flatnonzero(times == first[spots])
                signed[spots[best]] = marks[best]
        on = on[last[on] <= until[owner[on]]]
        if not len(on):
            latest = first.reshape(-1, places).max(axis=1)
            until = np.where(latest > until, np.minimum(latest, until * 1.25), -1.0)
            on = np.flatnonzero(last <= until[owner])
            until = np.maximum(until, 0)
    return signed.reshape(-1, places)


def signature(values: np.ndarray, counts: np.ndarray, places: int = BANDS * PLACES) -> np.ndarray:
    return signatures(values, counts, np.zeros(len(values), dtype=np.int64), places)[0]


def band_hashes(signed: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band of every signature, a row each."""
    rows = np.moveaxis(signed.reshape(len(signed), bands, -1), 2, 0)
    total = np.tile(np.arange(bands, dtype=U), (len(signed), 1))
    for column in rows:
        total = mix(total * U(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64)


def sketches(signed: np.ndarray) -> np.ndarray:
    """One bit of each of the first places, as 64-bit words, a row per signature; missing places are 0."""
    bits = np.zeros((len(signed), BITS), dtype=np.uint8)
    bits[:, : min(BITS, signed.shape[1])] = (signed[:, :BITS] & U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def fewest_equal(places: int, least: float) -> int:
    """Equal bits that a pair at similarity ``least`` has, but for five standard deviations."""
    equal, used = (1 + least) / 2, min(BITS, places)
    return int(BITS - used + used * equal - 5 * (used * equal * (1 - equal)) ** 0.5)


def sequence_keys(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two times 64 bits of the word sequence of every text; none is empty."""
    heads = np.cumsum(counts) - counts
    place = np.arange(len(words), dtype=U) - np.repeat(heads, counts).astype(U)
    keys = [mix(words + mix(place + U(seed))) for seed in (0x243F6A88, 0x85A308D3)]
    return [np.add.reduceat(key, heads).view(np.int64) if len(heads) else key.view(np.int64) for key in keys]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    _, i, k = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][k]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def text_shingles(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(word_hashes(text), size)


def sign(docs: DataFrame, size: int, bands: int, places: int) -> DataFrame:
    """``(_doc, _k1, _k2, _size, _b0 .. _b3, _bands)`` for every document with words."""
    kind = dict(docs.dtypes)["doc_id"]

    def rows(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        words, counts = words_of(texts)
        present = np.flatnonzero(counts)
        counts = counts[present]
        table = np.zeros((0, bands * places), dtype=U)
        if len(present):
            table = signatures(*shingles_of(words, counts, size), bands * places)
        bits = sketches(table)
        ends = np.arange(len(present) + 1, dtype=np.int32) * bands
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(present)),
                *map(pa.array, sequence_keys(words, counts)),
                pa.array(np.maximum(counts - size + 1, 1)),
                *[pa.array(bits[:, n]) for n in range(len(WORDS))],
                pa.ListArray.from_arrays(ends, band_hashes(table, bands).ravel()),
            ],
            names=["_doc", "_k1", "_k2", "_size", *WORDS, "_bands"],
        )

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, held = 0, [], 0
            for number, text in enumerate(batch.column("text")):
                texts.append(text.as_py())
                held += len(texts[-1])
                if len(texts) == TEXTS_AT_ONCE or held >= CHARS_AT_ONCE or number + 1 == batch.num_rows:
                    yield rows(batch.column("doc_id").slice(at, len(texts)), texts)
                    at, texts, held = number + 1, [], 0

    present = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    words = ", ".join(f"{w} bigint" for w in WORDS)
    return present.mapInArrow(signed, f"_doc {kind}, _k1 bigint, _k2 bigint, _size bigint, {words}, _bands array<bigint>")


def likely(left: str, right: str, fewest: int, least: float) -> Column:
    """Sizes and sketches of two rows (struct columns) do not rule the pair out."""
    a, b = F.col(left), F.col(right)
    different = sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in WORDS), F.lit(0))
    similar_size = F.least(a["_size"], b["_size"]) >= F.greatest(a["_size"], b["_size"]) * (least - 1e-9)
    return similar_size & (different <= BITS - fewest)


def verify(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs ``(_member, _center)`` whose exact overlap reaches ``least``.

    Centers travel once per ``PARTNERS`` members. Partitions are sorted, so that a task
    holds the shingles of one center and streams its members.
    """
    kind = dict(texts.dtypes)["doc_id"]
    salts = pairs.groupBy("_center").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("_salts"))
    members = (
        pairs.join(salts, "_center")
        .withColumn("_salt", F.pmod(F.xxhash64("_member"), F.col("_salts")).cast("int"))
        .join(texts, F.col("_member") == F.col("doc_id"))
        .select("_center", "_salt", F.lit(1).alias("_role"), "_member", "text")
    )
    centers = (
        salts.select("_center", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
        .join(texts, F.col("_center") == F.col("doc_id"))
        .select("_center", "_salt", F.lit(0).alias("_role"), F.col("_center").alias("_member"), "text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            names = ("_center", "_salt", "_role", "_member", "text")
            taken = []
            for number, (center, salt, role, _, text) in enumerate(zip(*(batch.column(n) for n in names), strict=True)):
                key = (center.as_py(), salt.as_py())
                if key != current:
                    current, held = key, []
                bag = text_shingles(text.as_py(), size)
                if role.as_py() == 0:
                    held.append(bag)
                elif any(similarity(bag, other) >= least - 1e-12 for other in held):
                    taken.append(number)
            chosen = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column("_member"), chosen.column("_center")], names=["_member", "_center"])

    return (
        members.unionByName(centers)
        .repartition("_center", "_salt")
        .sortWithinPartitions("_center", "_salt", "_role")
        .mapInArrow(compare, f"_member {kind}, _center {kind}")
    )


def own_shingles(texts: DataFrame, size: int) -> DataFrame:
    """``(_rep, _own)``: how many shingles of a text no other of ``texts`` has."""
    kind = dict(texts.dtypes)["doc_id"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                bags = [text_shingles(text.as_py(), size) for text in batch.column("text")]
                rows = np.repeat(np.arange(len(bags)), [len(values) for values, _ in bags])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows)),
                        pa.array(np.concatenate([values for values, _ in bags]).view(np.int64)),
                        pa.array(np.concatenate([counts for _, counts in bags]).astype(np.int64)),
                    ],
                    names=["_rep", "_shingle", "_count"],
                )

    spelled = texts.select("doc_id", "text").mapInArrow(spell, f"_rep {kind}, _shingle bigint, _count bigint")
    return (
        spelled.groupBy("_shingle")
        .agg(F.count("*").alias("_n"), F.min("_rep").alias("_rep"), F.sum("_count").alias("_count"))
        .where("_n = 1")
        .groupBy("_rep")
        .agg(F.sum("_count").alias("_own"))
    )


def elements(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a set: one element for the first, second, ... occurrence of each value."""
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(values, counts) + mix(place.astype(U)))


class Block:
    """Strays of one cell, by the elements they hold."""

    def __init__(self, rows: list[tuple[object, object, np.ndarray]]):
        self.ids, self.parts = [row[0] for row in rows], [row[1] for row in rows]
        self.sizes = np.array([len(row[2]) for row in rows])
        held, owner = np.concatenate([row[2] for row in rows]), np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(held, kind="stable")
        self.owner = owner[order]
        self.held, self.starts = np.unique(held[order], return_index=True)
        self.stops = np.append(self.starts[1:], len(owner))
        self.top: dict = {}

    def near(self, wanted: np.ndarray, least: float) -> np.ndarray:
        """Numbers of the strays whose exact weighted Jaccard similarity to ``wanted`` reaches ``least``."""
        if not len(self.held) or not len(wanted):
            return np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.held, wanted)
        at = at.clip(max=len(self.held) - 1)
        at = at[self.held[at] == wanted]
        lengths = self.stops[at] - self.starts[at]
        spots = np.arange(int(lengths.sum())) + np.repeat(self.starts[at] - np.cumsum(lengths) + lengths, lengths)
        shared = np.bincount(self.owner[spots], minlength=len(self.ids))
        return np.flatnonzero(shared >= (self.sizes + len(wanted) - shared) * (least - 1e-12))

    def joins(self, a: object, b: object) -> bool:
        """Whether a link between two parts is the first one of this cell to join them."""
        a, b = self._top(a), self._top(b)
        self.top[a] = b
        return a != b

    def _top(self, part: object) -> object:
        while (above := self.top.get(part, part)) != part:
            self.top[part] = self.top.get(above, above)
            part = above
        return part


def open_links(opened: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Links ``(_member, _center)`` that join different parts among the rows of one center.

    ``opened`` has ``(_center, _rep, _part, _size, _stray)``. The strays of a center are cut into
    stripes of bounded rows and shingles, all its rows likewise; a task holds one stripe of
    strays by their shingles and streams one stripe of rows past it. Every pair with a stray
    is compared exactly, none is a row of a table, and of the links of a cell only those
    that join two parts leave it.
    """
    kind = dict(texts.dtypes)["doc_id"]

    def stripes(which: Column) -> Column:
        rows, held = F.count(F.when(which, 1)), F.sum(F.when(which, F.col("_size")).otherwise(0))
        return F.ceil(F.greatest(rows / BLOCK_ROWS, held / BLOCK_SHINGLES)).cast("int")

    grid = (
        opened.groupBy("_center")
        .agg(stripes(F.col("_stray")).alias("_down"), stripes(F.lit(True)).alias("_across"))
        .where("_down > 0")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    placed = opened.withColumn("_salt", F.pmod(F.xxhash64("_rep"), F.lit(SALTS)).cast("int")).join(grid, ["_center", "_salt"])
    spot = F.xxhash64("_rep", F.lit(1))

    def copies(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    cell = ["_center", "_row", "_column"]
    strays = placed.where("_stray").select(
        "_center", "_rep", "_part", F.lit(0).alias("_role"), F.pmod(spot, "_down").cast("int").alias("_row"), copies("_across").alias("_column")
    )
    others = placed.select(
        "_center", "_rep", "_part", F.lit(1).alias("_role"), F.pmod(spot, "_across").cast("int").alias("_column"), copies("_down").alias("_row")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for number in range(batch.num_rows):
                center, row, column, role, rep, part, text = (
                    batch.column(n)[number].as_py() for n in (*cell, "_role", "_rep", "_part", "text")
                )
                if (center, row, column) != current:
                    current, held, block = (center, row, column), [], None
                wanted = elements(*text_shingles(text, size))
                if role == 0:
                    held.append((rep, part, wanted))
                    continue
                if block is None and held:
                    block, held = Block(held), []
                for n in block.near(wanted, least) if block else ():
                    if block.joins(block.parts[n], part):
                        found[0].append(rep)
                        found[1].append(block.ids[n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, batch.column("_rep").type) for column in found], names=["_member", "_center"]
            )

    return (
        strays.unionByName(others)
        .join(texts, F.col("_rep") == F.col("doc_id"))
        .drop("doc_id")
        .repartition(*cell)
        .sortWithinPartitions(*cell, "_role")
        .mapInArrow(compare, f"_member {kind}, _center {kind}")
    )


def near_groups(
    docs: DataFrame, least: float = 0.8, size: int = SHINGLE, bands: int = BANDS, places: int = PLACES
) -> DataFrame:
    """``(doc_id, group_id)`` of every document with words; a group is named by its smallest id."""
    docs = docs.select("doc_id", "text")
    signed = cut_lineage(sign(docs, size, bands, places))
    keys = ["_k1", "_k2"]
    facts = F.struct("_size", *WORDS)
    nodes = signed.groupBy(*keys).agg(
        F.min("_doc").alias("_rep"), F.first(facts).alias("_facts"), F.first("_bands").alias("_bands")
    )
    fewest = fewest_equal(bands * places, least)
    postings = nodes.select("_rep", F.explode("_bands").alias("_bucket"))
    shared = postings.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    buckets = cut_lineage(postings.join(shared, "_bucket"))
    degree = buckets.groupBy("_rep").agg(F.sum("_n").alias("_degree"))
    centers = cut_lineage(
        buckets.join(degree, "_rep")
        .groupBy("_bucket")
        .agg(F.max(F.struct("_degree", "_rep")).alias("_top"))
        .select("_bucket", F.col("_top._rep").alias("_center"))
    )
    wanted = buckets.select("_rep").distinct()
    texts = cut_lineage(docs.join(wanted, F.col("doc_id") == F.col("_rep"), "left_semi"))

    known = cut_lineage(nodes.join(wanted, "_rep", "left_semi").select("_rep", "_facts"))
    starred = buckets.join(centers, "_bucket").where("_rep <> _center").select(F.col("_rep").alias("_member"), "_center").distinct()
    first = cut_lineage(
        starred.join(known.select(F.col("_rep").alias("_member"), F.col("_facts").alias("_left")), "_member")
        .join(known.select(F.col("_rep").alias("_center"), F.col("_facts").alias("_right")), "_center")
        .where(likely("_left", "_right", fewest, least))
        .select("_member", "_center")
    )
    links = cut_lineage(verify(first, texts, size, least).distinct())

    placed = buckets.join(components(links, "_member", "_center"), F.col("_rep") == F.col("_node"), "left").select(
        "_bucket", "_rep", F.coalesce("_component", "_rep").alias("_part")
    )
    sizes = placed.groupBy("_bucket", "_part").agg(F.count("*").alias("_n"))
    mixed = (
        sizes.groupBy("_bucket")
        .agg(F.max_by("_part", F.struct("_n", "_part")).alias("_main"), F.count("*").alias("_parts"))
        .where("_parts > 1")
        .drop("_parts")
    )
    open_places = cut_lineage(placed.join(mixed, "_bucket"))
    opened = open_places.select("_rep").distinct()
    own = own_shingles(texts.join(opened, F.col("doc_id") == F.col("_rep"), "left_semi"), size)
    facts_of = opened.join(known, "_rep").join(own, "_rep", "left").select("_rep", "_facts", F.coalesce("_own", F.lit(0)).alias("_own"))
    alike = F.col("_facts._size") - F.col("_own") >= F.col("_facts._size") * least - 1e-9
    open_rows = (
        open_places.join(facts_of.where(alike).select("_rep", F.col("_facts._size").alias("_size")), "_rep")
        .join(centers, "_bucket")
        .groupBy("_center", "_rep")
        .agg(
            F.first("_part").alias("_part"),
            F.first("_size").alias("_size"),
            F.max(F.col("_part") != F.col("_main")).alias("_stray"),
        )
    )
    more = open_links(cut_lineage(open_rows), texts, size, least).distinct()
    groups = components(links.unionByName(more), "_member", "_center")
    named = nodes.drop("_bands", "_facts").join(groups, F.col("_rep") == F.col("_node"), "left")
    return (
        signed.select("_doc", *keys)
        .join(named.select(*keys, F.coalesce("_component", "_rep").alias("group_id")), keys)
        .groupBy(F.col("_doc").alias("doc_id"))
        .agg(F.min("group_id").alias("group_id"))
    )


def mark_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``_group`` and ``_kept``; documents outside any group stand for themselves."""
    docs = plain(docs)
    groups = near_groups(docs, **settings).select(F.col("doc_id").alias("_id"), F.col("group_id").alias("_group"))
    group = F.coalesce("_group", "doc_id")
    return (
        docs.join(groups, F.col("doc_id") == F.col("_id"), "left")
        .withColumn("_group", group)
        .withColumn("_kept", F.coalesce(F.col("doc_id") == F.col("_group"), F.lit(True)))
        .drop("_id")
    )
