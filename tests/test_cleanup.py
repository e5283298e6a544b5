from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
from test_relational import greedy

from cairnlake import session
from cairnlake.operators import duplicates, pivots


def test_greedy_cleanup_walks_on_where_a_front_ends_early(spark, monkeypatch):
    for name, value in (("FRONT_LEAST", 2), ("FRONT_MOST", 3)):
        monkeypatch.setattr(duplicates, name, value)
    rng = random.Random(8)
    words = [f"word{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 14))) for _ in range(12)]
    rows = [(f"id{i:03}", rng.choice(texts), "hot" if i % 2 else f"s{i % 6}") for i in range(90)]
    df = spark.createDataFrame(rows, "id string, text string, source_file string")
    for threshold in (0.5, 0.8):
        decided = duplicates.greedy_cleanup(df, threshold, 5, salt_rows=4).collect()
        assert len(decided) == 90
        assert {r["id"] for r in decided if r["kept"]} == greedy(rows, threshold, 5)


def test_greedy_cleanup_of_repeated_ids_equals_its_rounds(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(12)]
    rows = [(f"id{i:03}", " ".join(rng.choices(words, k=rng.randint(4, 9))), f"s{i % 4}") for i in range(60)]
    longest = max((r for r in rows if r[2] == "s0"), key=lambda r: (len(r[1]), r[0]))
    rows += [longest, rows[5], (rows[2][0], "word1 word2 word3 word4 word5 word6 word7 word8 word9", "s3"), (None, rows[7][1], "s1"), ("idx", None, "s3")]
    df = spark.createDataFrame(rows, "id string, text string, source_file string")
    got = Counter(map(tuple, duplicates.greedy_cleanup(df, 0.8).collect()))
    kept = Counter(r["id"] for r in duplicates._rounds(df, duplicates.source_groups(df), 0.8, 2048, 5).collect())
    want = Counter()
    for name, _, source in rows:
        want[(source, name, kept[name] > 0 and name is not None)] += max(kept[name], 1) if name else 1
    assert got == want


def test_greedy_cleanup_stores_no_bags(spark):
    rng = random.Random(4)
    rows = [(f"id{i:03}", " ".join(f"{rng.getrandbits(40):x}" for _ in range(400)), f"s{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, text string, source_file string").repartition(4)
    session.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def stored() -> int:
        return sum(path.stat().st_size for path in folder.rglob("part-*"))

    before = stored()
    assert sum(r["kept"] for r in duplicates.greedy_cleanup(df, 0.85).collect()) == 300
    assert stored() - before < sum(len(r[1]) for r in rows) / 10


def test_pivots_go_on_through_slices_and_batches(monkeypatch):
    monkeypatch.setattr(pivots, "SLICE_TOKENS", 20)
    rng = random.Random(6)
    texts = sorted((" ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) for _ in range(120)), key=lambda t: -len(t))
    rows = [{"pivot": False, "source_file": f"s{i // 40}", "id": f"{i:03}", "text": t, "limit": 50, "own": True, "tokens": t.split()} for i, t in enumerate(texts)]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    found = [r for b in pivots.walk(0.7, 5)(iter(batches)) for r in b.to_pylist()]

    def cosine(a, b):
        a, b = Counter(a), Counter(b)
        norm = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
        return sum(n * b[t] for t, n in a.items()) / norm if norm else 0.0

    laid, stay = [], set()
    for source in ("s0", "s1", "s2"):
        own = [r for r in rows if r["source_file"] == source]
        chosen = []
        for row in own:
            if all(cosine(p["tokens"], row["tokens"]) < 0.7 for p in chosen[:5]):
                chosen.append(row)
        assert [r["id"] for r in found if r["source_file"] == source and r["mark"] == pivots.PIVOT] == [r["id"] for r in chosen[:5]]
        stay |= {r["id"] for r in chosen[5:]}
        laid += [{**r, "pivot": True} for r in chosen[:5]] + own
    kept = [r["id"] for b in pivots.survivors(0.7, ["source_file"], ["id"])(iter(pa.Table.from_pylist(laid).to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert set(kept) == stay and len(kept) == len(stay)
