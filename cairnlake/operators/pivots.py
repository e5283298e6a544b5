"""Bags of tokens against the pivots of their group, as one Arrow step over sorted rows.

A group's pivots come before its rows. Token counts of a slice of rows are made at once
and compared with a pivot by one look-up table, so a row costs its tokens, not those of
the pivot. Only one slice and the pivots of the group at hand are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are counted at once.
SLICE_TOKENS = 1 << 19
#: What a row of ``walk`` stands for.
PIVOT, MORE, TANGLED = 0, 1, 2


@dataclass
class _Pivot:
    id: pa.Scalar
    tokens: pa.Array
    counts: np.ndarray
    norm: float
    codes: np.ndarray | None = None


@dataclass
class _Group:
    """The group at hand: its pivots, the rows seen and whether the walk goes on."""

    key: tuple
    pivots: list[_Pivot] = field(default_factory=list)
    seen: int = 0
    limit: int = 0
    tangled: bool = False


class _Bags:
    """Token counts of the rows of a batch, beside those of pivots met before."""

    def __init__(self, batch: pa.RecordBatch, pivots: list[_Pivot]) -> None:
        listed = batch.column("tokens")
        sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = listed.flatten()
        coded = pa.concat_arrays([flat, *[pivot.tokens for pivot in pivots]]).dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
        keys, self.counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * words + codes[: len(flat)], return_counts=True)
        self.words, self.rows, self.codes = coded.dictionary, keys // words, keys % words
        self.starts = np.searchsorted(self.rows, np.arange(len(sizes) + 1))
        self.norms = np.sqrt(np.bincount(self.rows, weights=self.counts * self.counts, minlength=len(sizes)))
        self.table = np.zeros(words, np.int64)
        at = len(flat)
        for pivot in pivots:
            pivot.codes = codes[at : at + len(pivot.tokens)]
            at += len(pivot.tokens)

    def pivot(self, row: int, name: pa.Scalar) -> _Pivot:
        span = slice(self.starts[row], self.starts[row + 1])
        codes = self.codes[span]
        return _Pivot(name, self.words.take(pa.array(codes)), self.counts[span], float(self.norms[row]), codes)

    def cosines(self, pivot: _Pivot, low: int, high: int) -> np.ndarray:
        """Cosine of rows ``low`` to ``high`` with a pivot, zero where a bag is empty; sums are exact."""
        span = slice(self.starts[low], self.starts[high])
        self.table[pivot.codes] = pivot.counts
        products = self.counts[span] * self.table[self.codes[span]]
        self.table[pivot.codes] = 0
        dots = np.bincount(self.rows[span] - low, weights=products, minlength=high - low)
        lengths = self.norms[low:high] * pivot.norm
        return np.divide(dots, lengths, out=np.zeros(high - low), where=lengths > 0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about ``SLICE_TOKENS`` tokens."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = (np.cumsum(sizes) - sizes) // SLICE_TOKENS
        edges = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            if high > low:
                yield batch.slice(low, high - low)


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Key and range of every run of rows with equal keys."""
    changed = np.zeros(batch.num_rows - 1, bool)
    for key in keys:
        codes = batch.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        changed |= np.diff(codes) != 0
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:], strict=False):
        yield tuple(batch.column(key)[low].as_py() for key in keys), low, high


def _alive(bags: _Bags, batch: pa.RecordBatch, pivots: list[_Pivot], alive: np.ndarray, low: int, high: int, threshold: float) -> np.ndarray:
    """Which rows of a range no pivot is close to and none is."""
    ids = batch.column("id").slice(low, high - low)
    for pivot in pivots:
        other = pc.fill_null(pc.not_equal(ids, pivot.id), False).to_numpy(zero_copy_only=False)
        alive = alive & other & (bags.cosines(pivot, low, high) < threshold)
    return alive


def survivors(threshold: float, keys: list[str], kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows that stay: the pivots of a group (``pivot``) come first and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(())
        for batch in _slices(batches):
            bags = _Bags(batch, group.pivots)
            known = batch.column("pivot").to_numpy(zero_copy_only=False)
            stay = ~known
            for key, low, high in _groups(batch, keys):
                if key != group.key:
                    group = _Group(key)
                group.pivots += [bags.pivot(row, batch.column("id")[row]) for row in range(low, high) if known[row]]
                stay[low:high] = _alive(bags, batch, group.pivots, stay[low:high], low, high, threshold)
            yield batch.filter(pa.array(stay)).select(kept)

    return run


def walk(threshold: float, most: int, key: str = "source_file") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The next pivots of every group, up to ``most`` with those that come first.

    Rows lie in the order of the rule. ``MORE`` marks a group whose rows, as many as its
    ``limit``, end before its last pivot; ``TANGLED`` one that met a pivot without an id of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, schema = _Group(()), pa.schema([])

        def marks() -> Iterator[pa.RecordBatch]:
            mark = TANGLED if group.tangled else MORE
            if group.tangled or (len(group.pivots) < most and 0 < group.limit <= group.seen):
                values = {key: group.key[0], "mark": mark}
                yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

        for batch in _slices(batches):
            names = [key, "id", "text"]
            schema = pa.schema([*[(name, batch.schema.field(name).type) for name in names], ("mark", pa.int32())])
            bags = _Bags(batch, group.pivots)
            known = batch.column("pivot").to_numpy(zero_copy_only=False)
            own = pc.fill_null(batch.column("own"), True).to_numpy(zero_copy_only=False)
            chosen: list[int] = []
            for found, low, high in _groups(batch, [key]):
                if found != group.key:
                    yield from marks()
                    group = _Group(found)
                group.seen += int(np.count_nonzero(~known[low:high]))
                group.limit = batch.column("limit")[high - 1].as_py() or 0
                group.pivots += [bags.pivot(row, batch.column("id")[row]) for row in range(low, high) if known[row]]
                alive = _alive(bags, batch, group.pivots, ~known[low:high], low, high, threshold)
                while len(group.pivots) < most and alive.any() and not group.tangled:
                    row = low + int(alive.argmax())
                    group.tangled = not own[row]
                    group.pivots.append(bags.pivot(row, batch.column("id")[row]))
                    alive = _alive(bags, batch, group.pivots[-1:], alive, low, high, threshold)
                    chosen.append(row)
            rows = batch.take(pa.array(chosen, pa.int64())).select(names)
            mark = pa.array(np.full(len(chosen), PIVOT, np.int32))
            yield pa.RecordBatch.from_arrays([*rows.columns, mark], schema=schema)
        yield from marks()

    return run
