"""Quality classifier by co-training.

Two views of a document are classified apart: the text view sees hashed words and the
shape of the text (case, symbols, repetition, lengths), the metadata view sees source,
language and recorded length. Both start from labelled documents. In each round each view
labels the pool documents it is surest of and hands them to the other view, which is
trained again on its own examples plus those. On held-out labelled documents the two
scores are calibrated and combined by a small logistic model, which then scores every
document. A document is acceptable if it is of good quality and not toxic.

Bounds of the training data (documented parameters): ``labelled`` labelled documents and
``pool`` unlabelled ones, those with the smallest id hashes. Everything else covers all
documents, whole texts included.

Defined results: null and empty texts are scored by their shape and metadata; without
labels of both classes every document is kept with score 1; labels without a quality are
ignored, a null toxicity is none; repeated labels of one id count as the worst of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.frames import plain
from cairnlake.llm.hashing import MARKS, U, word_hashes

WORDS = 1 << 20
SHAPES = 1 << 10
FEWEST = 4


def bin_of(value: float, edges: tuple[float, ...]) -> int:
    return int(np.searchsorted(edges, value, side="right"))


SHARES = (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
LENGTHS = (2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0, 10.0, 15.0)
UPPER = np.array([65 <= b <= 90 for b in range(256)])
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?" for b in range(256)])


def shape_features(text: str, words: np.ndarray) -> list[int]:
    """One binned feature per property of the text as a whole."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    size, letters, n = max(1, len(data)), max(1, int(counts[LETTER].sum())), len(words)
    distinct, times = np.unique(words, return_counts=True) if n else (words, np.zeros(0))
    lines = text.split("\n")
    follows = np.count_nonzero(words[1:] == words[:-1]) if n else 0
    values = (
        bin_of(np.log2(n + 1), tuple(range(1, 24))),
        bin_of(letters / max(1, n), LENGTHS),
        bin_of(counts[UPPER].sum() / letters, SHARES),
        bin_of(counts[SYMBOL].sum() / size, SHARES),
        bin_of(counts[DIGIT].sum() / size, SHARES),
        bin_of(len(distinct) / max(1, n), SHARES),
        bin_of(times.max() / n if n else 0.0, SHARES),
        bin_of(follows / max(1, n), SHARES),
        bin_of(1 - len(set(lines)) / len(lines), SHARES),
        bin_of(np.log2(size / len(lines) + 1), tuple(range(1, 24))),
        bin_of(text.count(".") / max(1, n), SHARES),
    )
    return [WORDS + (place * 32 + value) % SHAPES for place, value in enumerate(values)]


def text_features(text: str | None) -> np.ndarray:
    text = text or ""
    words = word_hashes(text, MARKS)
    hashed = np.unique((words & U(WORDS - 1)).astype(np.int32))
    return np.concatenate([hashed, np.array(shape_features(text, words), dtype=np.int32)])


def metadata_features(source: object, lang: object, n_chars: object) -> np.ndarray:
    size = "none" if n_chars is None else int(np.log2(max(0, int(n_chars)) + 1) * 2)
    joined = "\n".join(f"s={source}/l={lang}/n={size}/sl={source},{lang}/ln={lang},{size}".split("/"))
    return (word_hashes(joined) & U(WORDS - 1)).astype(np.int32)


@dataclass
class Rows:
    """Sparse binary rows: the ids of all rows one after another, and where each row starts."""

    ids: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        return cls(np.concatenate(rows) if rows else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(lengths)]))

    def pick(self, chosen: np.ndarray) -> Rows:
        return Rows.of([self.ids[self.starts[i] : self.starts[i + 1]] for i in chosen])


class Linear:
    """Logistic model over the features seen in at least ``FEWEST`` training rows."""

    def __init__(self, rows: Rows, target: np.ndarray, steps: int = 200, decay: float = 2e-4):
        ids, seen = np.unique(rows.ids, return_counts=True)
        self.ids = ids[seen >= FEWEST]
        self.weights, self.bias = np.zeros(len(self.ids)), 0.0
        place, row = self._places(rows)
        first, second = np.zeros(len(self.ids) + 1), np.zeros(len(self.ids) + 1)
        current = np.zeros(len(self.ids) + 1)
        for step in range(1, steps + 1):
            margin = np.bincount(row, current[place], minlength=len(target)) + current[-1]
            error = 1 / (1 + np.exp(-margin)) - target
            gradient = np.append(np.bincount(place, error[row], minlength=len(self.ids)), error.sum()) / len(target)
            gradient[:-1] += decay * current[:-1]
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            current -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights, self.bias = current[:-1].astype(np.float32), float(current[-1])

    def _places(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Position among the known features and row of every known feature occurrence."""
        row = np.repeat(np.arange(len(rows.starts) - 1), np.diff(rows.starts))
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.ids, rows.ids), len(self.ids) - 1)
        known = self.ids[place] == rows.ids
        return place[known], row[known]

    def margins(self, rows: Rows) -> np.ndarray:
        place, row = self._places(rows)
        return np.bincount(row, self.weights[place], minlength=len(rows.starts) - 1) + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class CoTrained:
    """Both views and their combination."""

    def __init__(self, views: tuple[Rows, Rows], target: np.ndarray, pool: tuple[Rows, Rows], rounds: int, share: float, sure: float):
        held = np.arange(len(target)) % 5 == 0
        own, kept = np.flatnonzero(~held), np.flatnonzero(held)
        size = len(pool[0].starts) - 1
        given: list[dict[int, float]] = [{}, {}]
        self.models: list[Linear] = []
        for _ in range(rounds + 1):
            self.models = []
            for view in (0, 1):
                taken = np.array(sorted(given[view]), dtype=np.int64)
                rows = Rows.of(
                    [views[view].ids[views[view].starts[i] : views[view].starts[i + 1]] for i in own]
                    + [pool[view].ids[pool[view].starts[i] : pool[view].starts[i + 1]] for i in taken]
                )
                answers = np.concatenate([target[own], [given[view][i] for i in taken]])
                self.models.append(Linear(rows, answers))
            for view in (0, 1):
                chance = sigmoid(self.models[view].margins(pool[view]))
                for label, surest in ((1.0, np.argsort(-chance)), (0.0, np.argsort(chance))):
                    picked = surest[: int(size * share / 2)]
                    right = chance[picked] >= sure if label else chance[picked] <= 1 - sure
                    for i in picked[right]:
                        given[1 - view].setdefault(int(i), label)
        self.exchanged = (len(given[0]), len(given[1]))
        margins = np.stack([m.margins(v.pick(kept)) for m, v in zip(self.models, views, strict=True)], axis=1)
        self.mean, self.spread = margins.mean(axis=0), margins.std(axis=0) + 1e-6
        self.blend = self._blend((margins - self.mean) / self.spread, target[kept])
        self.accuracy = float(((self._combined(margins) >= 0.5) == (target[kept] >= 0.5)).mean())

    @staticmethod
    def _blend(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Logistic calibration of the two standardised margins, by Newton steps with a small ridge."""
        design = np.column_stack([x, np.ones(len(x))])
        weights = np.zeros(3)
        for _ in range(25):
            chance = sigmoid(design @ weights)
            slope = design.T @ (y - chance) - 0.1 * weights
            curve = (design * (chance * (1 - chance))[:, None]).T @ design + 0.1 * np.eye(3)
            weights = weights + np.linalg.solve(curve, slope)
        return weights

    def _combined(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(((margins - self.mean) / self.spread) @ self.blend[:2] + self.blend[2])

    def score(self, views: tuple[Rows, Rows]) -> np.ndarray:
        return self._combined(np.stack([m.margins(v) for m, v in zip(self.models, views, strict=True)], axis=1))


def _views(docs: DataFrame) -> DataFrame:
    """``docs`` with the packed features of both views."""

    @F.arrow_udf("struct<text:binary,meta:binary>")
    def features(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = zip(texts, sources, langs, sizes, strict=True)
        packed = [(text_features(t.as_py()), metadata_features(s.as_py(), g.as_py(), n.as_py())) for t, s, g, n in rows]
        return pa.StructArray.from_arrays(
            [pa.array([p[k].tobytes() for p in packed], pa.binary()) for k in (0, 1)], ["text", "meta"]
        )

    return docs.withColumn("_views", features("text", "source", "lang", "n_chars"))


def _unpacked(rows: list) -> tuple[Rows, Rows]:
    return tuple(Rows.of([np.frombuffer(row["_views"][k], np.int32) for row in rows]) for k in ("text", "meta"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    labelled: int = 8000,
    pool: int = 8000,
    rounds: int = 3,
    share: float = 0.1,
    sure: float = 0.95,
) -> CoTrained | None:
    """A co-trained model; ``share`` of the pool and at least ``sure`` bound what a round exchanges."""
    order = F.xxhash64("doc_id")
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") * (1 - F.max(F.coalesce("toxic", F.lit(0))))).cast("double").alias("_target"))
    )
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    chosen = ids.join(known, "doc_id").orderBy(order, "doc_id").limit(labelled)
    others = ids.join(known, "doc_id", "left_anti").orderBy(order, "doc_id").limit(pool).withColumn("_target", F.lit(-1.0))
    # At most labelled + pool rows of an id and a number.
    wanted = F.broadcast(chosen.unionByName(others).dropDuplicates(["doc_id"]))
    rows = _views(plain(docs).join(wanted, "doc_id")).select("doc_id", "_target", "_views").orderBy(order, "doc_id").collect()
    learned, free = [r for r in rows if r["_target"] >= 0], [r for r in rows if r["_target"] < 0]
    target = np.array([r["_target"] for r in learned])
    if len(target) < 50 or not 0 < target.mean() < 1:
        return None
    return CoTrained(_unpacked(learned), target, _unpacked(free), rounds, share, sure)


def score_documents(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with ``_score``, the chance that a document is acceptable."""
    docs = plain(docs)
    if model is None:
        return docs.withColumn("_score", F.lit(1.0))

    @F.arrow_udf("double")
    def scored(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 512):
            part = [column.slice(at, 512) for column in (texts, sources, langs, sizes)]
            own = Rows.of([text_features(t.as_py()) for t in part[0]])
            rest = zip(*part[1:], strict=True)
            meta = Rows.of([metadata_features(s.as_py(), g.as_py(), n.as_py()) for s, g, n in rest])
            out.append(model.score((own, meta)))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn("_score", scored("text", "source", "lang", "n_chars"))


def accepted(score: Column, least: float = 0.5) -> Column:
    return F.coalesce(score >= least, F.lit(True))
