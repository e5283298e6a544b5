"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The symbols of a word lie in an array with links to their neighbours; leaf ``i`` of the
tree holds the rank of the pair that starts at symbol ``i`` together with its place, so the
root is the leftmost pair of lowest rank. A merge changes at most three leaves, each
updated in logarithmic time, until the root shows no mergeable pair.

Texts are cut at the special tokens, normalised and split into words as the vocabulary
file demands (BPE with word ends). The distinct words of a slice of text are encoded side
by side: words of similar length form one matrix, whose rows are their trees, and every
round merges the root pair of each tree that still shows one. Very long words are merged
one by one in the same kind of tree. Nothing is kept from slice to slice, so memory is
bounded by ``SLICE``, a longer text aside, and whole texts are encoded at any length.

Defined results: a null or empty text has no tokens and decodes to the empty text; each
row is encoded for itself, also when ids or texts repeat; other columns pass through, but
for those whose name starts with an underscore; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cairnlake.llm.frames import plain

#: Code points that Python lower-cases, composes and splits as the tokenizer's own rules do.
UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\u024f]")
WHITE = re.compile(r"\s+")
#: Bytes of text that are encoded and handed on at once.
SLICE = 2 << 20
#: Symbols of a word up to which it is merged side by side with others, and cells of such a matrix.
SHORT, CELLS = 256, 1 << 19
NONE = 1 << 62
PLACES = 1 << 40
WIDE = 24


class PairTree:
    """Minimum tree over the leaves of one word."""

    def __init__(self, leaves: list[int]):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.nodes = [NONE] * self.width + leaves + [NONE] * (self.width - len(leaves))
        for node in range(self.width - 1, 0, -1):
            self.nodes[node] = min(self.nodes[2 * node], self.nodes[2 * node + 1])

    def root(self) -> int:
        return self.nodes[1]

    def update(self, leaf: int, value: int) -> None:
        nodes, node = self.nodes, leaf + self.width
        nodes[node] = value
        node >>= 1
        while node:
            left, right = nodes[2 * node], nodes[2 * node + 1]
            lowest = left if left < right else right
            if nodes[node] == lowest:
                break
            nodes[node] = lowest
            node >>= 1


class Merges:
    """Rank and result of every pair, looked up for one pair or for arrays of them."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        keys = np.array([a << WIDE | b for a, b, _ in merges], dtype=np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.results = np.array([merged for _, _, merged in merges], dtype=np.int64)

    def leaves(self, first: np.ndarray, second: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of pairs: rank and place, or ``NONE``; a negative symbol pairs with nothing."""
        if not len(self.keys):
            return np.full(np.broadcast(first, second, place).shape, NONE)
        key = first << WIDE | second
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (first >= 0) & (second >= 0)
        return np.where(known, self.rank[at] * PLACES + place, NONE)

    def leaf(self, first: int, second: int, place: int) -> int:
        return int(self.leaves(np.array([first]), np.array([second]), np.array([place]))[0])


def merge_word(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """Symbols of one word after all merges."""
    n = len(symbols)
    tree = PairTree(merges.leaves(symbols[:-1], symbols[1:], np.arange(n - 1)).tolist())
    symbols = symbols.tolist()
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while (best := tree.root()) != NONE:
        i = best % PLACES
        j = after[i]
        k = after[i] = after[j]
        symbols[i], symbols[j] = int(merges.results[best // PLACES]), -1
        if j < n - 1:
            tree.update(j, NONE)
        tree.update(i, merges.leaf(symbols[i], symbols[k], i) if k < n else NONE)
        if k < n:
            before[k] = i
        if before[i] >= 0:
            tree.update(before[i], merges.leaf(symbols[before[i]], symbols[i], before[i]))
    return np.array([symbol for symbol in symbols if symbol >= 0], dtype=np.int64)


def merge_words(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """Rows of ``symbols`` (padded with -1) after all merges; merged places are -1."""
    words, n = symbols.shape
    symbols, place = symbols.copy(), np.arange(n)
    after = np.broadcast_to(place + 1, (words, n)).copy()
    before = np.broadcast_to(place - 1, (words, n)).copy()
    nodes = np.full((words, 2 * n), NONE)
    nodes[:, n : 2 * n - 1] = merges.leaves(symbols[:, :-1], symbols[:, 1:], place[:-1])
    for node in range(n - 1, 0, -1):
        np.minimum(nodes[:, 2 * node], nodes[:, 2 * node + 1], out=nodes[:, node])
    word = np.flatnonzero(nodes[:, 1] != NONE)
    while len(word):
        best = nodes[word, 1]
        i = best % PLACES
        j = after[word, i]
        k = after[word, j]
        merged = merges.results[best // PLACES]
        symbols[word, i], symbols[word, j], after[word, i] = merged, -1, k
        inside = k < n
        before[word[inside], k[inside]] = i[inside]
        following = np.where(inside, symbols[word, np.minimum(k, n - 1)], -1)
        h = before[word, i]
        leading = np.where(h >= 0, symbols[word, h], -1)
        leaf = np.concatenate([j, i, np.maximum(h, 0)]) + n
        value = np.concatenate(
            [np.full(len(word), NONE), merges.leaves(merged, following, i), merges.leaves(leading, merged, h)]
        )
        real = np.concatenate([np.ones(2 * len(word), dtype=bool), h >= 0])
        row, node = np.concatenate([word, word, word])[real], leaf[real]
        nodes[row, node] = value[real]
        for _ in range(n.bit_length() - 1):
            node = node >> 1
            nodes[row, node] = np.minimum(nodes[row, 2 * node], nodes[row, 2 * node + 1])
        word = word[nodes[word, 1] != NONE]
    return symbols


def byte_letters() -> list[str]:
    """Letter for each byte: printable Latin bytes stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {byte: chr(256 + n) for n, byte in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(byte) or chr(byte) for byte in range(256)]


class Coder:
    """Encoder and decoder of one vocabulary file, given as its text."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        vocabulary = parsed["model"]["vocab"]
        letters = [(letter, letter + parsed["model"]["end_of_word_suffix"]) for letter in byte_letters()]
        #: Symbol of each byte inside a word and at its end, -1 where the vocabulary has none.
        self.bytes = np.array([[vocabulary.get(name, -1) for name in pair] for pair in letters], dtype=np.int64)
        self.merges = Merges([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in parsed["model"]["merges"]])
        self.specials = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        names = {number: token for token, number in (vocabulary | self.specials).items()}
        self.tokens = pa.array([names.get(number) for number in range(max(names, default=-1) + 1)], pa.string())
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.words = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Only the normaliser is asked, so the library need not hold the vocabulary as well.
        bare = {**parsed, "model": {**parsed["model"], "vocab": {}, "merges": []}, "added_tokens": []}
        self.library = Tokenizer.from_str(json.dumps(bare))

    def split(self, piece: str) -> list[str]:
        """Words of a piece of text between special tokens."""
        if UNUSUAL.search(piece):
            piece = self.library.normalizer.normalize_str(piece)
        else:
            piece = WHITE.sub(" ", piece).lower()
        return self.words.findall(piece)

    def words_of(self, text: str) -> list[str]:
        """Words and special tokens of a text; a special token is marked by a leading NUL, which no word of letters has."""
        if not self.cut or "<|" not in text:
            return self.split(text)
        found: list[str] = []
        for place, piece in enumerate(self.cut.split(text)):
            found += ["\0" + piece] if place % 2 else self.split(piece)
        return found

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word behind the other, and where each begins and ends."""
        special = [self.specials.get(word[1:], -1) if word[0] == "\0" else -1 for word in words]
        coded = [b"" if number >= 0 else word.encode("utf-8", "surrogatepass") for word, number in zip(words, special, strict=True)]
        sizes = np.array([len(word) for word in coded])
        data = np.frombuffer(b"".join(coded), np.uint8)
        last = np.zeros(len(data), dtype=np.int64)
        last[np.cumsum(sizes)[sizes > 0] - 1] = 1
        symbols, owner = self.bytes[data, last], np.repeat(np.arange(len(words)), sizes)
        owner, symbols = owner[symbols >= 0], symbols[symbols >= 0]
        lengths = np.bincount(owner, minlength=len(words))
        heads = np.cumsum(lengths) - lengths
        owners, merged = [np.flatnonzero(np.array(special) >= 0)], [np.array([n for n in special if n >= 0], dtype=np.int64)]
        for chosen, width in self._classes(lengths):
            if width > SHORT:
                for word in chosen.tolist():
                    found = merge_word(symbols[heads[word] : heads[word] + lengths[word]], self.merges)
                    owners.append(np.full(len(found), word))
                    merged.append(found)
                continue
            step = max(1, CELLS // width)
            for at in range(0, len(chosen), step):
                part = chosen[at : at + step]
                grid = np.full((len(part), width), -1, dtype=np.int64)
                inside = np.arange(width) < lengths[part, None]
                grid[inside] = symbols[(heads[part, None] + np.arange(width))[inside]]
                grid = merge_words(grid, self.merges) if width > 1 else grid
                alive = grid >= 0
                owners.append(np.repeat(part, alive.sum(axis=1)))
                merged.append(grid[alive])
        owner, ids = np.concatenate(owners), np.concatenate(merged)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))

    @staticmethod
    def _classes(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Words of 1, 2, 3 to 4, 5 to 8, ... symbols, with the width of their matrix."""
        width, least = 1, 0
        while (lengths > least).any():
            chosen = np.flatnonzero((lengths > least) & (lengths <= width))
            if len(chosen):
                yield chosen, width
            width, least = 2 * width, width

    def encode_texts(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """Per text: ids as little-endian unsigned 32-bit integers, and the text they decode to."""
        found = [self.words_of(text) if text else [] for text in texts]
        ends = np.cumsum([0, *map(len, found)])
        coded = pa.array([word for words in found for word in words], pa.large_string()).dictionary_encode()
        if not len(coded):
            return pa.array([b""] * len(texts), pa.binary()), pa.array([""] * len(texts), pa.string())
        ids, at = self.word_ids(coded.dictionary.to_pylist())
        word = coded.indices.to_numpy()
        counts = (at[1:] - at[:-1])[word]
        last = np.cumsum(counts)
        ids = ids[np.repeat(at[:-1][word] - last + counts, counts) + np.arange(last[-1])]
        offsets = np.append(0, last)[ends]
        packed = pa.Array.from_buffers(
            pa.binary(), len(texts), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
        )
        return packed, self.decode_ids(ids, offsets)

    def decode_ids(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Tokens of each text joined by blanks; unknown ids are left out."""
        named = self.tokens.take(pa.array(np.where(ids < len(self.tokens), ids, 0).astype(np.int64)))
        known = np.array(pc.is_valid(named).to_numpy(zero_copy_only=False)) & (ids < len(self.tokens))
        if not known.all():
            named = named.filter(pa.array(known))
            offsets = np.append(0, np.cumsum(known))[offsets]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), named)
        return pc.binary_join(lists, " ")

    def encode(self, text: str | None) -> tuple[bytes, str]:
        ids, decoded = self.encode_texts([text])
        return ids[0].as_py(), decoded[0].as_py()

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0].as_py()


_coders: dict[int, Coder] = {}


def _coder(definition: Broadcast) -> Coder:
    """One coder per vocabulary and Python worker."""
    key = hash(definition.value)
    if key not in _coders:
        _coders[key] = Coder(definition.value)
    return _coders[key]


def load_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file for all executors; its size is that of the file, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``_ids`` (packed, see ``Coder.encode``), ``_n_tokens`` and ``_decoded``."""
    definition = load_vocabulary(docs.sparkSession, path)

    docs = plain(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids, decoded = coder.encode_texts(part.column(part.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, ids, decoded], names=[*part.schema.names, "_ids", "_decoded"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_ids", T.BinaryType()), T.StructField("_decoded", T.StringType())])
    return docs.mapInArrow(scan, schema).withColumn("_n_tokens", F.floor(F.length("_ids") / 4).cast("long"))


def byte_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts hold about ``SLICE`` bytes; a longer text is a part of its own."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE
    heads = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    for first, last in zip(heads, heads[1:], strict=False):
        yield batch.slice(first, last - first)


def decode(docs: DataFrame, path: str, ids: str = "_ids") -> DataFrame:
    """``docs`` with the text of packed ids as ``_decoded``."""
    definition = load_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("string")
    def decoded(packed: pa.Array) -> pa.Array:
        coder = _coder(definition)
        out = []
        for item in packed:
            ids_of_row = array("I")
            ids_of_row.frombytes(item.as_py() or b"")
            out.append(coder.decode(ids_of_row.tolist()))
        return pa.array(out, pa.string())

    return docs.withColumn("_decoded", decoded(F.col(ids)))


def id_array(packed: Column) -> Column:
    """Packed ids as an array of numbers, for engines that read lists."""
    text = F.hex(packed)
    places = F.when(F.length(packed) > 0, F.sequence(F.lit(0), F.length(packed) - 4, F.lit(4))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        places,
        lambda p: F.conv(
            F.concat(*[F.substring(text, p * 2 + (2 * k + 1), F.lit(2)) for k in (3, 2, 1, 0)]), 16, 10
        ).cast("long"),
    )
