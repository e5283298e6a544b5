"""Near duplicates, repeated strings, components, classifier and pipeline against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import near_texts, near_vectors, quality, suffixes
from cairnlake.llm.components import components
from cairnlake.llm.hashing import shingles, shingles_of, word_hashes, words_of
from cairnlake.session import cut_lineage


def union_find(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


class TestComponents:
    def test_stars_take_no_round(self, spark, monkeypatch):
        cuts = []
        monkeypatch.setattr("cairnlake.llm.components.cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
        edges = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (4, 4)], "a int, b int")
        got = components(edges, "a", "b", rounds=1)
        assert len(cuts) == 1
        assert {r["_node"]: r["_component"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 5: 4, 4: 4}
        assert components(edges.where("a > 9"), "a", "b", rounds=1).count() == 0

    @pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
    def test_equal_union_find(self, spark, kind):
        pick = random.Random(4)
        links = {
            "random": [(pick.randint(0, 80), pick.randint(0, 80)) for _ in range(60)],
            "path": [(n, n + 1) for n in random.Random(1).sample(range(60), 60)],
            "star": [(0, n) for n in range(1, 90)],
            "none": [(3, 3)],
        }[kind]
        got = {r["_node"]: r["_component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
        nodes = {n for a, b in links if a != b for n in (a, b)}
        assert got == union_find(nodes, [(a, b) for a, b in links if a != b])


class TestRepeats:
    def brute(self, rows, length):
        seen, out = {}, []
        for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            data = (text or "").encode()
            gone = bytearray(len(data))
            for p in range(len(data) - length + 1):
                if seen.setdefault(data[p : p + length], (i, p)) != (i, p):
                    gone[p : p + length] = b"\1" * length
            spans = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
            out.append((i, len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone, strict=True) if not g)))
        return out

    def texts(self, seed):
        pick = random.Random(seed)
        words = ["".join(pick.choice("abcde") for _ in range(pick.randint(1, 6))) for _ in range(60)]

        def some(n):
            return " ".join(pick.choice(words) for _ in range(n))

        base, rows = some(120), []
        for i in range(90):
            kind, at = pick.randint(0, 6), pick.randint(0, 300)
            changed = base.split(" ")
            changed[pick.randrange(120)] = "X"
            rows.append(
                (
                    i,
                    [
                        some(pick.randint(0, 200)),
                        base,
                        some(20) + base[at : at + pick.randint(90, 300)] + some(20),
                        "ab " * pick.randint(10, 200),
                        " ".join(changed),
                        rows[pick.randrange(len(rows))][1] if rows else None,
                        some(10) + "é" * pick.randint(0, 150) + base[:at],
                    ][kind],
                )
            )
        return rows

    @pytest.mark.parametrize(("seed", "run_rows", "per_batch"), [(1, 1 << 16, "10000"), (2, 3, "10000"), (3, 1 << 16, "4")])
    def test_equals_brute_force(self, spark, seed, run_rows, per_batch):
        rows = self.texts(seed)
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
        try:
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
            got = suffixes.dedup_repeats(docs, run_rows=run_rows).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        found = sorted((r["doc_id"], r["_n_bytes"], r["_n_removed"], len(r["_removed"]), bytes(r["_kept"])) for r in got)
        assert found == self.brute(rows, suffixes.LENGTH)
        assert any(r[2] for r in found)

    def test_slices_of_a_long_text(self, monkeypatch):
        pick = random.Random(8)
        data = np.frombuffer("".join(pick.choice("abcd") for _ in range(5000)).encode(), np.uint8)

        def windows():
            return {(int(s) + k, int(s + lead)) for _, _, start, leads, n in suffixes.blocks_of(data) for s, lead, c in zip(start, leads, n, strict=True) for k in range(c)}

        whole = windows()
        monkeypatch.setattr(suffixes, "SLICE", 700)
        assert windows() == whole
        assert {p for p, _ in whole} == set(range(5000 - 99))

    def test_blocks_of_many_texts_are_those_of_each(self):
        pick = random.Random(11)
        texts = ["".join(pick.choice("abcd") for _ in range(n)).encode() for n in (0, 1, 99, 100, 101, 0, 700, 50, 2000, 3)]
        data = [np.frombuffer(t, np.uint8) for t in texts]
        *together, number = suffixes.blocks_of_texts(data)
        alone = [(n, *row) for n, d in enumerate(data) for blocks in suffixes.blocks_of(d) for row in zip(*(c.tolist() for c in blocks), strict=True)]
        assert list(zip(number.tolist(), *(c.tolist() for c in together), strict=True)) == alone
        assert not len(suffixes.blocks_of_texts(data[:2])[0])
        assert list(suffixes.joined(np.array([1 << 15, 1 << 15, 5, 1 << 20, 7]))) == [[0, 1], [2], [3], [4]]

    def test_texts_without_an_id_are_told_apart(self, spark):
        pick = random.Random(3)
        shared = "".join(pick.choice("abcdefghij") for _ in range(130))
        own = ["".join(pick.choice("abcdefghij") for _ in range(150)) for _ in range(3000)]
        rows = [(None, shared + t if n % 2 else t) for n, t in enumerate(own)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        removed = {r["text"]: r["_n_removed"] for r in suffixes.dedup_repeats(docs).collect()}
        assert {removed[t] for _, t in rows if not t.startswith(shared)} == {0}
        losses = sorted(removed[t] for _, t in rows if t.startswith(shared))
        assert losses[0] == 0 and losses[1] >= len(shared)

    def test_odd_rows(self, odd_docs, no_docs):
        got = suffixes.dedup_repeats(odd_docs).collect()
        assert len(got) == odd_docs.count()
        for row in got:
            data = (row["text"] or "").encode()
            assert row["_n_bytes"] == len(data)
            assert row["_n_bytes"] - row["_n_removed"] == len(row["_kept"])
        assert suffixes.dedup_repeats(no_docs).count() == 0

    def test_repeated_rows_are_one_document(self, spark):
        text = " ".join(f"w{n}" for n in range(100))
        docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, text[:300])], "doc_id long, text string")
        got = sorted((r["doc_id"], r["_n_removed"]) for r in suffixes.dedup_repeats(docs).collect())
        assert got == [(1, 0), (1, 0), (2, len(text)), (3, 300)]


class TestNearTexts:
    def test_signatures_estimate_weighted_jaccard(self):
        pick = np.random.default_rng(3)
        errors = []
        for _ in range(30):
            values = pick.integers(0, 1 << 62, 60).astype(np.uint64)
            a, b = pick.integers(1, 9, 60), pick.integers(1, 9, 60)
            true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
            signs = [near_texts.signature(np.sort(values), c[np.argsort(values)]) for c in (a, b)]
            errors.append((signs[0] == signs[1]).mean() - true)
        assert abs(np.mean(errors)) < 0.015
        assert max(map(abs, errors)) < 0.1

    def test_time_bound_does_not_change_a_signature(self):
        values, counts = np.arange(1, 9, dtype=np.uint64), np.array([1, 2, 3, 1, 1, 40, 1, 7])
        wide = near_texts.signature(values, counts)
        found = [
            p
            for level, low, high, rows in near_texts.intervals(counts)
            for p in near_texts.points(near_texts.mix(values[rows] + np.uint64(level * 0x632BE59BD9B4E019 % (1 << 64))), counts[rows], low, high, 400.0, 512)
        ]
        place, time, mark = (np.concatenate(c) for c in zip(*found, strict=True))
        best = {}
        for p, t, m in zip(place, time, mark, strict=True):
            best[p] = min(best.get(p, (np.inf, 0)), (t, m))
        assert all(wide[p] == m for p, (_, m) in best.items())

    def test_signatures_of_many_texts_are_those_of_each(self, monkeypatch):
        pick = random.Random(9)
        texts = [" ".join(f"w{pick.randint(0, 60)}" for _ in range(n)) for n in (1, 4, 5, 6, 40, 300, 700)] + ["", None, "la " * 900]
        words, counts = words_of(texts)
        assert words.tolist() == [w for t in texts for w in word_hashes(t).tolist()]
        values, times, owner = shingles_of(words, counts[counts > 0])
        alone = [shingles(word_hashes(t)) for t in texts if t]
        assert values.tolist() == [v for bag in alone for v in bag[0].tolist()]
        assert times.tolist() == [n for bag in alone for n in bag[1].tolist()]
        signed = near_texts.signatures(values, times, owner)
        monkeypatch.setattr(near_texts, "CELLS", 50)
        assert [s.tolist() for s in signed] == [near_texts.signature(*bag).tolist() for bag in alone]

    def test_few_more_points_are_drawn_than_fill_the_places(self, monkeypatch):
        drawn, draw = [], near_texts.draw
        monkeypatch.setattr(near_texts, "draw", lambda keys, last, rate, width: drawn.append(len(keys) * width) or draw(keys, last, rate, width))
        pick = np.random.default_rng(4)
        for n in (20, 100, 500):
            bags = [np.sort(pick.integers(0, 1 << 62, n).astype(np.uint64)) for _ in range(20)]
            near_texts.signatures(np.concatenate(bags), np.ones(20 * n, dtype=np.int64), np.repeat(np.arange(20), n))
        # 512 places are filled by 3,500 points in the mean.
        assert sum(drawn) < 60 * 6000

    def brute(self, rows, least=0.8):
        bags = {i: shingles(word_hashes(t)) for i, t in rows if i is not None and (t or "").split()}
        ids = sorted(bags)
        links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if near_texts.similarity(bags[a], bags[b]) >= least - 1e-12]
        return union_find(ids, links)

    def test_groups_equal_brute_force(self, spark):
        pick = random.Random(6)

        def some(n):
            return [pick.choice("abcdefghij") + str(pick.randint(0, 40)) for _ in range(n)]

        bases, rows = [some(pick.randint(5, 150)) for _ in range(12)], []
        for i in range(160):
            words = list(pick.choice(bases))
            for _ in range(pick.choice([0, 0, 1, 2, 4, 8])):
                words[pick.randrange(len(words))] = "x" + str(pick.randint(0, 9))
            rows.append((i, " ".join(words)))
        rows += [(200, "la " * 300), (201, "la " * 290), (202, "la " * 200), (203, "one two"), (204, "One  two"), (205, ""), (206, None)]
        got = near_texts.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert {r["doc_id"]: r["group_id"] for r in got.collect()} == self.brute(rows)

    @pytest.mark.parametrize("rows_a_stripe", [3, 1024])
    def test_strays_of_a_bucket_are_linked_too(self, spark, monkeypatch, rows_a_stripe):
        """One place per band makes buckets of dissimilar texts; their links must still be found."""
        monkeypatch.setattr(near_texts, "BLOCK_ROWS", rows_a_stripe)
        pick = random.Random(7)
        words = [f"w{n}" for n in range(60)]
        rows = []
        for i in range(40):
            cut = pick.randint(0, 30)
            rows.append((i, " ".join(words[cut : cut + 30] + [f"z{i % 5}"] * 3)))
        got = near_texts.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), bands=64, places=1)
        assert {r["doc_id"]: r["group_id"] for r in got.collect()} == self.brute(rows)

    def test_block_counts_multiset_overlap(self):
        pick = np.random.default_rng(5)

        def bag():
            values = np.unique(pick.integers(0, 12, pick.integers(1, 12)).astype(np.uint64))
            return values, pick.integers(1, 5, len(values))

        bags = [bag() for _ in range(40)]
        block = near_texts.Block([(n, n, near_texts.elements(*b)) for n, b in enumerate(bags)])
        for wanted in [bag() for _ in range(40)]:
            near = [n for n, b in enumerate(bags) if near_texts.similarity(b, wanted) >= 0.5 - 1e-12]
            assert block.near(near_texts.elements(*wanted), 0.5).tolist() == near
        none = np.zeros(0, dtype=np.uint64)
        assert not len(block.near(none, 0.5))
        assert not len(near_texts.Block([(1, 1, none)]).near(near_texts.elements(*bags[0]), 0.5))

    def test_only_links_that_join_parts_leave_a_block(self):
        block = near_texts.Block([(n, n, near_texts.elements(*shingles(word_hashes("a b c d e f"), 5))) for n in range(3)])
        assert [block.joins(a, b) for a, b in [(0, 1), (1, 0), (1, 2), (0, 2), (2, 2)]] == [True, False, True, False, False]

    def test_odd_rows(self, odd_docs, no_docs):
        marked = near_texts.mark_near_duplicates(odd_docs).collect()
        assert len(marked) == odd_docs.count()
        kept = sorted(r["doc_id"] for r in marked if r["_kept"] and r["doc_id"] is not None)
        assert kept == [1, 2, 3, 5, 8, 9, 10]
        assert near_texts.mark_near_duplicates(no_docs).count() == 0


class TestNearVectors:
    def brute(self, rows, cosine):
        good = {}
        for i, e, label in rows:
            if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
                good[i] = (label, np.array(e, dtype=np.float64) / np.linalg.norm(e))
        links = [
            (a, b)
            for a in good
            for b in good
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= cosine
        ]
        parts = union_find([r[0] for r in rows], links)
        counts = {r[0]: 0 for r in rows}
        for a, b in links:
            counts[a] += 1
            counts[b] += 1
        return [(i, counts[i], parts[i], parts[i] == i) for i in sorted(counts)]

    @pytest.mark.parametrize("cell_rows", [4, 2048])
    def test_equals_brute_force(self, spark, monkeypatch, cell_rows):
        monkeypatch.setattr(near_vectors, "CHUNK", 16)
        draw = np.random.default_rng(cell_rows)
        centers = draw.standard_normal((12, 24))
        rows = []
        for i in range(300):
            v = centers[draw.integers(12)] + draw.standard_normal(24) * draw.choice([0, 0.05, 0.12, 0.2, 1])
            rows.append((i, [float(x) for x in v * draw.choice([1, 3])], int(draw.integers(3)) if i % 11 else None))
        rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 24, 1), (403, [float("nan")] * 24, 1), (404, [float("inf")] + [1.0] * 23, 1)]
        rows += [(405, [None] * 24, 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, [1.0, 2.0], 2)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
        got = near_vectors.near_vectors(table, 0.98, cell_rows=cell_rows).orderBy("vec_id").collect()
        assert [tuple(r) for r in got] == self.brute(rows, 0.98)

    def test_odd_tables(self, spark):
        schema = "vec_id long, embedding array<float>, label int, _node string, kept string"
        assert near_vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
        rows = [(None, [1.0, 0.0], 1, "x", "y"), (1, [1.0, 0.0], 1, "x", "y"), (1, [1.0, 0.0], 1, "x", "y"), (2, [1.0, 0.0], 1, "x", "y")]
        got = sorted(map(tuple, near_vectors.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
        assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False)]


class TestQuality:
    def corpus(self, spark, n=900):
        pick = random.Random(12)
        good = [f"good{k}" for k in range(80)]
        rows, labels = [], []
        for i in range(n):
            kind = pick.random()
            words = [pick.choice(good) for _ in range(pick.randint(30, 90))]
            if kind < 0.2:
                words = [w.upper() + "!!" for w in words]
            elif kind < 0.35:
                words[3:3] = [pick.choice(["nasty", "vile", "foul"]) for _ in range(3)]
            rows.append((i, " ".join(words), "en", f"s{i % 4}", 10 * len(words)))
            if i % 3:
                labels.append((i, 0 if kind < 0.2 else 1, 1 if 0.2 <= kind < 0.35 else 0))
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        truth = {r[0]: not (r[1].isupper() or any(w in r[1] for w in ("nasty", "vile", "foul")) or "!!" in r[1]) for r in rows}
        return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth

    def test_held_out_accuracy_and_exchange(self, spark):
        docs, labels, truth = self.corpus(spark)
        model = quality.train(docs, labels)
        assert model.accuracy > 0.95
        scored = quality.score_documents(docs, model).collect()
        unseen = [r for r in scored if r["doc_id"] % 3 == 0]
        assert sum((r["_score"] >= 0.5) == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.95
        assert max(model.exchanged) > 0

    def test_odd_rows(self, spark, odd_docs, no_docs):
        docs, labels, _ = self.corpus(spark)
        model = quality.train(docs, labels)
        assert quality.score_documents(odd_docs, model).where(F.col("_score").between(0, 1)).count() == odd_docs.count()
        assert quality.score_documents(no_docs, model).count() == 0
        assert quality.train(docs, labels.limit(0)) is None
        assert quality.score_documents(odd_docs, None).where("_score = 1").count() == odd_docs.count()


class TestPipeline:
    def test_stages_keep_the_columns_and_take_effect(self, spark):
        import corpus_pipeline

        folder = "/root/testdata/sf0.001"
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns, sizes = docs.columns, [docs.count()]
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder).cache()
            sizes.append(docs.count())
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
            if name == "near_dedup":
                rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
                assert len(set(TestNearTexts().brute(rows).values())) == sum(1 for _, t in rows if t.split())
        assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
        assert corpus_pipeline.run(spark, folder).count() == sizes[-1]
