"""Vectorised hashes of words, shingles and byte strings; equal on every machine."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
START = 1 << 16

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is no letter or digit parts words; bytes of other letters do not.
MARKS = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    """An odd random number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``; the table doubles when a longer text comes."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(START, 1 << (n - 1).bit_length())
        known = np.ones(size, dtype=U)
        done = 1
        while done < size:
            known[done : 2 * done] = known[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = known
    return known[:n]


def prefix_hashes(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """Polynomial hash of every prefix; ``range_hashes`` reads those of substrings off it."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(byte_values(seed)[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the substrings ``[start, stop)``: equal strings have equal hashes wherever they stand."""
    inverse = powers(INVERSE, len(prefix))
    return mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(U) * U(0xC2B2AE3D27D4EB4F))


def gram_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """``range_hashes`` of all substrings of ``size`` bytes, in order."""
    total = prefix[size:] - prefix[:-size]
    total *= powers(INVERSE, len(prefix))[: len(total)]
    total += U(size * 0xC2B2AE3D27D4EB4F % (1 << 64))
    return mix(total)


def words_of(texts: list[str | None], parting: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, in order, and the number of words of each text."""
    parts = [(text or "").lower().encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b" ".join(parts), np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(parting[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    counts = np.diff(np.searchsorted(edges[::2], np.cumsum([len(part) + 1 for part in parts])), prepend=0)
    if not len(edges):
        return np.zeros(0, dtype=U), counts
    return range_hashes(prefix_hashes(data), edges[::2], edges[1::2]), counts


def word_hashes(text: str | None, parting: np.ndarray = SPACES) -> np.ndarray:
    """Hashes of the lower-cased words of a text, in order."""
    return words_of([text], parting)[0]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    total = np.full(len(words) - size + 1, U(size), dtype=U)
    for column in range(size):
        total *= U(0x9FB21C651E98DF25)
        total += words[column : column + len(total)]
        total = mix(total)
    return total


def shingles_of(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted, with their counts and the number of their text.

    ``words`` has the words of all texts, ``counts`` how many each text has, at least one.
    Fewer words than ``size`` make one shingle.
    """
    if not len(words):
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    held = np.maximum(counts - size + 1, 1)
    heads, starts = np.cumsum(held) - held, np.cumsum(counts) - counts
    runs = shingle_hashes(words, size) if len(words) >= size else None
    values = np.empty(int(held.sum()), dtype=U)
    for head, n, start, count in zip(heads.tolist(), held.tolist(), starts.tolist(), counts.tolist(), strict=True):
        own = runs[start : start + n] if count >= size else shingle_hashes(words[start : start + count], count)
        values[head : head + n] = own
        values[head : head + n].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[heads] = True
    first = np.flatnonzero(new)
    return values[first], np.diff(first, append=len(values)), np.searchsorted(heads, first, side="right") - 1


def shingles(words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words, sorted, with their counts; fewer words make one shingle."""
    return shingles_of(words, np.array([len(words)]), size)[:2]
