"""Secret scan by grammar inference.

Values of labelled credentials (assignments, access keys and hex runs that the base rules
find in all documents) build one prefix tree per label; states
whose continuations are statistically compatible are merged into a probabilistic
automaton. Every token of every text that is as long as an assigned value may be (12
characters) and has a letter and a digit is then a candidate and scored by the likelihood of
its format: bits per symbol above an automaton learned the same way from ordinary tokens.
Tokens of letters or of digits alone score 0: their format is that of words in capitals
and of dates and numbers. Spans of the base rules always stay; a candidate beyond ``margin`` that overlaps
none of them is added as kind ``format``.

Bounds of the training sample (documented parameters): of the distinct values of a label in
all documents the ``per_label`` with the smallest hashes, of a value the first ``longest``
characters (a longer one teaches no ending). With fewer than ``fewest`` values a label
gets no automaton; with none at all only base spans are found.

Defined results: a null or empty text has no span; other columns pass through,
but for those whose name starts with an underscore.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm import spans
from cairnlake.llm.frames import plain
from cairnlake.session import cut_lineage

KINDS = ("assign", "access", "hex")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}+")
END = "$"
CLASSES = {
    **dict.fromkeys("0123456789", "d"),
    **dict.fromkeys("abcdef", "h"),
    **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"),
    **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U"),
}
SPAN_TYPE = "array<struct<kind:string,start:int,stop:int,score:double>>"
ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])
)
SPACE = 16


def symbols(value: str) -> list[str]:
    """Format of a value: digit, hex letter, other lower case, upper case, or the character itself."""
    return [CLASSES.get(c, c) for c in value]


class Automaton:
    """Probabilistic automaton merged from the prefix tree of its sample.

    Counts of passing and ending strings sit on the states. In breadth-first order each
    state is either compatible with an accepted one, by the Hoeffding bound at ``alpha`` on
    every outgoing and ending frequency and along common continuations, and folded into
    it, or accepted itself.
    """

    def __init__(self, sample: Iterable[str], alpha: float = 0.05, longest: int | None = None):
        self.alpha, self.longest = alpha, longest
        self.next: list[dict[str, int]] = [{}]
        self.through: list[Counter] = [Counter()]
        for value in sample:
            state = 0
            for symbol in symbols(value[:longest]):
                self.through[state][symbol] += 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.through.append(Counter())
                state = self.next[state][symbol]
            if longest is None or len(value) <= longest:
                self.through[state][END] += 1
        self._merge()

    def _differ(self, a: Counter, b: Counter) -> bool:
        n, m = a.total(), b.total()
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(a[s] / n - b[s] / m) > bound for s in a.keys() | b.keys())

    def _compatible(self, a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            one, other = waiting.pop()
            if self._differ(self.through[one], self.through[other]):
                return False
            waiting += [(self.next[one][s], to) for s, to in self.next[other].items() if s in self.next[one]]
        return True

    def _fold(self, kept: int, gone: int) -> None:
        """Add the tree below ``gone`` to the automaton from ``kept`` on."""
        waiting = [(kept, gone)]
        while waiting:
            one, other = waiting.pop()
            self.through[one].update(self.through[other])
            for symbol, to in self.next[other].items():
                if symbol in self.next[one]:
                    waiting.append((self.next[one][symbol], to))
                else:
                    self.next[one][symbol] = to

    def _merge(self) -> None:
        accepted, seen = [0], {0}
        while True:
            edges = ((state, s, to) for state in accepted for s, to in sorted(self.next[state].items()) if to not in seen)
            state, symbol, to = next(edges, (None, None, None))
            if state is None:
                break
            match = next((old for old in accepted if self._compatible(old, to)), None)
            if match is None:
                accepted.append(to)
                seen.add(to)
            else:
                self.next[state][symbol] = match
                self._fold(match, to)
        self.states = len(accepted)

    def bits(self, value: str) -> float:
        """Mean log2 probability per symbol; unseen steps get a small share.

        The ending counts as a symbol where the sample taught endings, up to ``longest``.
        """
        state, total, parts = 0, 0.0, symbols(value)
        if self.longest is None or len(value) <= self.longest:
            parts.append(END)
        for place, symbol in enumerate(parts):
            counts = self.through[state]
            total += math.log2((counts[symbol] + 0.05) / (counts.total() + 0.05 * SPACE))
            if symbol != END:
                step = self.next[state].get(symbol)
                if step is None:
                    total += (len(parts) - place - 1) * -math.log2(SPACE) * 2
                    break
                state = step
        return total / len(parts)


class Formats:
    """Automata of the labels and of ordinary tokens, with the score a candidate must reach."""

    def __init__(self, labelled: dict[str, Sequence[str]], ordinary: Sequence[str], fewest: int, margin: float, longest: int | None = None):
        self.models = {label: Automaton(values, longest=longest) for label, values in labelled.items() if len(values) >= fewest}
        self.ordinary = Automaton(ordinary, longest=longest)
        self.margin = margin
        self.least = {
            label: sorted(model.bits(v) for v in labelled[label])[len(labelled[label]) // 50]
            for label, model in self.models.items()
        }

    def score(self, value: str) -> float:
        """Bits per symbol by which the best fitting credential format beats ordinary tokens, or 0."""
        if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
            return 0.0
        fits = [bits for label, model in self.models.items() if (bits := model.bits(value)) >= self.least[label]]
        return max(0.0, max(fits) - self.ordinary.bits(value)) if fits else 0.0


def base_spans(text: str) -> list[spans.Span]:
    found = [(kind, start, stop) for kind, start, stop, _ in spans.assigned(text)]
    found += [*spans.access_keys(text), *spans.hex_runs(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def uncovered(text: str, covered: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens of ``text`` that overlap no covered span."""
    base, at = sorted(covered), 0
    for match in TOKEN.finditer(text):
        start, stop = match.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        if at == len(base) or base[at][0] >= stop:
            yield start, stop


def secret_spans(text: str | None, formats: Formats | None) -> list[tuple[str, int, int, float]]:
    """Spans of one text by start: base ones with score 1, added ones with theirs."""
    if not text:
        return []
    found = [(*span, 1.0) for span in base_spans(text)]
    if formats and formats.models:
        for start, stop in uncovered(text, [(s[1], s[2]) for s in found]):
            value = formats.score(text[start:stop])
            if value >= formats.margin:
                found.append(("format", start, stop, round(value, 3)))
    return sorted(found, key=lambda s: (s[1], (*KINDS, "format").index(s[0]), s[2]))


def training_values(docs: DataFrame, per_label: int, longest: int) -> tuple[dict[str, list[str]], list[str]]:
    """Per label, and for ordinary tokens, the distinct values of all documents with the smallest hashes.

    Each task keeps the ``per_label`` smallest of its documents, so the global choice reads
    few rows. A value longer than ``longest`` comes with one character more.
    """

    def smallest(found: set[tuple[int, str]]) -> set[tuple[int, str]]:
        return found if len(found) <= per_label else set(heapq.nsmallest(per_label, found))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, set[tuple[int, str]]] = {label: set() for label in (*KINDS, "ordinary")}
        bound = dict.fromkeys(kept, 1 << 63)

        def add(label: str, value: str) -> None:
            value = value[: longest + 1]
            order = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") >> 1
            if order <= bound[label]:
                kept[label].add((order, value))
                if len(kept[label]) >= 4 * per_label:
                    kept[label] = smallest(kept[label])
                    bound[label] = max(kept[label])[0]

        for batch in batches:
            for item in batch.column("text"):
                text = item.as_py() or ""
                covered = []
                for _, start, stop, value in spans.assigned(text):
                    covered.append((start, stop))
                    add("assign", value)
                for kind, start, stop in (*spans.access_keys(text), *spans.hex_runs(text)):
                    covered.append((start, stop))
                    add(kind, text[start:stop])
                for start, stop in uncovered(text, covered):
                    add("ordinary", text[start:stop])
        rows = [(label, order, value) for label, found in kept.items() for order, value in smallest(found)]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["label", "h", "value"])

    chosen = cut_lineage(docs.select("text").mapInArrow(choose, "label string, h long, value string"))
    gathered: dict[str, list[str]] = {}
    for label in (*KINDS, "ordinary"):
        rows = chosen.where(F.col("label") == label).distinct().orderBy("h", "value").limit(per_label).collect()
        gathered[label] = [row["value"] for row in rows]
    return {label: gathered[label] for label in KINDS}, gathered["ordinary"]


def learn_formats(
    docs: DataFrame, per_label: int = 600, fewest: int = 20, margin: float = 0.5, longest: int = 128
) -> Formats | None:
    """Formats of the labelled values of all documents, or None when there are none."""
    labelled, ordinary = training_values(docs, per_label, longest)
    return Formats(labelled, ordinary, fewest, margin, longest) if any(labelled.values()) else None


def find_secrets(docs: DataFrame, formats: Formats | None) -> DataFrame:
    """``docs`` with ``_spans``: ``(kind, start, stop, score)`` by start, then kind as listed."""

    @F.arrow_udf(SPAN_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "stop", "score")
        return pa.array(
            [[dict(zip(names, span, strict=True)) for span in secret_spans(t.as_py(), formats)] for t in texts], ARROW_SPANS
        )

    return plain(docs).withColumn("_spans", found(F.col("text")))


def redact(docs: DataFrame, formats: Formats | None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        out = []
        for item in texts:
            text = item.as_py()
            if text:
                parts, done = [], 0
                for _, start, stop, _ in sorted(secret_spans(text, formats), key=lambda s: (s[1], -s[2])):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, stop)
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn("text", replaced(F.col("text")))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
