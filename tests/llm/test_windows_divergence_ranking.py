"""Word windows, source divergence and ranked search against brute force and on odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairnlake.llm import divergence, ranking, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {code: code + 32 for code in range(65, 91)}
SCALE = 1_000_000_000


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def kept_words(rows, length):
    """``(n_words, n_removed, kept)`` per ``(doc_id, text)`` in order of id."""
    seen, out = {}, {}
    for number, (doc, text) in enumerate(rows):
        words = WORD.findall(text or "")
        away = [False] * len(words)
        for at in range(len(words) - length + 1):
            if seen.setdefault(tuple(words[at : at + length]), (number, at)) != (number, at):
                away[at : at + length] = [True] * length
        out[doc, text] = (len(words), sum(away), " ".join(w for w, gone in zip(words, away, strict=True) if not gone))
    return out


class TestWindows:
    def check(self, spark, rows, length=windows.LENGTH, **options):
        docs = frame(spark, rows, "doc_id long, text string")
        got = {
            (r["doc_id"], r["text"]): (r["_n_words"], r["_n_removed"], r["_kept"])
            for r in windows.dedup_windows(docs, length, **options).collect()
        }
        assert got == kept_words(rows, length)

    @pytest.mark.parametrize("length", [3, 20])
    @pytest.mark.parametrize("passes", [1, 3])
    def test_random_texts(self, spark, length, passes):
        pick = random.Random(length)
        passage = [f"p{n}" for n in range(45)]
        rows = []
        for doc in range(120):
            words = [f"w{pick.randint(0, 30)}" for _ in range(pick.randint(0, 120))]
            if pick.random() < 0.5:
                start = pick.randint(0, 20)
                words[5:5] = passage[start : start + pick.randint(15, 25)]
            rows.append((doc, pick.choice([" ", "\n", "\t \r"]).join(words)))
        rows += [(200 + n, rows[n % 4][1]) for n in range(30)]
        self.check(spark, rows, length, passes=passes)

    def test_one_word_over_and_over(self, spark):
        self.check(spark, [(1, "same " * 300), (2, "same " * 20), (3, "same " * 19), (4, "other " + "same " * 40)])

    def test_hot_anchors_only_change_the_dealing(self, spark):
        pick = random.Random(5)
        line = " ".join(f"l{n}" for n in range(12))
        rows = [(n, " ".join([*[f"a{pick.randint(0, 50)}" for _ in range(15)], line, *[f"b{pick.randint(0, 5)}" for _ in range(15)]])) for n in range(80)]
        docs = frame(spark, rows, "doc_id long, text string")
        assert windows.hot_anchors(docs, 20)
        self.check(spark, rows)

    def test_text_longer_than_a_step(self, monkeypatch):
        monkeypatch.setattr(windows, "STEP", 64)
        words = [f"w{n * n % 97}" for n in range(400)]
        cut = windows.Slice([(1, 5, " ".join(words).encode())], 20)
        found = np.concatenate([at for at, _, _ in cut.windows()])
        hashes = np.concatenate([h for _, _, h in cut.windows()])
        assert found.tolist() == list(range(381))
        for a in range(0, 381, 7):
            for b in range(0, 381, 5):
                assert (hashes[a] == hashes[b]) == (words[a : a + 20] == words[b : b + 20])

    def test_spans_are_maximal(self, spark):
        text = " ".join(f"w{n}" for n in range(60))
        docs = frame(spark, [(1, text), (2, "x " + text + " y")], "doc_id long, text string")
        spans = {r["doc_id"]: [tuple(s) for s in r["_removed"]] for r in windows.dedup_windows(docs).collect()}
        assert spans == {1: [], 2: [(1, 61)]}

    def test_odd_rows(self, spark, odd_docs, no_docs):
        rows = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
        ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        got = windows.dedup_windows(odd_docs, 5)
        assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "size" not in got.columns and "count" in got.columns
        assert got.count() == odd_docs.count()
        assert {(r["doc_id"], r["text"]): (r["_n_words"], r["_n_removed"], r["_kept"]) for r in got.collect()} == kept_words(ordered, 5)
        assert windows.dedup_windows(no_docs).collect() == []

    def test_a_third_without_an_id(self, spark):
        rows = [(None, f"{n} " + " ".join(f"w{k}" for k in range(25))) for n in range(20)] + [(n, "w " * n) for n in range(40)]
        got = windows.dedup_windows(frame(spark, rows, "doc_id long, text string")).where("doc_id IS NULL").collect()
        assert sorted(r["_n_removed"] for r in got) == [0] + [25] * 19


def divergences(rows, min_docs=3, top=200):
    """Rows of the audit, group by group."""
    groups, langs, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in LETTERS.findall(text or "")]
        groups[lang or "", source or ""].update(terms)
        langs[lang or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in langs:
        kept = [t for t in held[lang] if held[lang][t] >= min_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + SCALE * (counts[t] + 1) // (total + len(kept)) for t in kept}

        own = {source: shares(counts) for (name, source), counts in groups.items() if name == lang}
        whole = shares(langs[lang])
        for source, p in own.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), item) for item, q in own.items() if item != source]
            terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[lang, source][t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1) if part == "pair" or rank <= top]
    return sorted(out)


class TestDivergence:
    def check(self, docs, **options):
        rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
        got = sorted(tuple(r) for r in divergence.audit(docs, **options).collect())
        assert got == divergences(rows, options.get("min_docs", 3), options.get("top_terms", 200))
        return got

    @pytest.mark.parametrize("block", [3, 1000])
    def test_random_texts(self, spark, block):
        pick = random.Random(block)
        rows = []
        for doc in range(150):
            words = [pick.choice(["Ab", "aB", "c", "d_e", "é9é", "ΑΣ", "x" * pick.randint(1, 12)]) for _ in range(pick.randint(0, 40))]
            rows.append((doc, " ".join(words), pick.choice(["en", "de", None, ""]), pick.choice(["a", "é", None, "Z", "b"])))
        self.check(frame(spark, rows), block=block, top_terms=4)

    def test_tiles_give_every_pair_once(self, spark):
        rows = [(n, f"a b c {'d ' * (n % 7)}", "en", f"s{n % 9}") for n in range(90)]
        words = divergence.vocabulary(divergence.term_counts(frame(spark, rows)), 3).cache()
        whole = sorted(tuple(r) for r in divergence.pair_sums(words).collect())
        assert len(whole) == 72 and whole == sorted(tuple(r) for r in divergence.pair_sums(words, block=2, tile=2).collect())

    def test_lang_without_kept_terms(self, spark):
        got = self.check(frame(spark, [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "en", None), (4, "x", "fr", "a")]))
        assert len(got) == 6 and all(row[4] == 0 for row in got)

    def test_group_without_terms_keeps_its_pairs(self, spark):
        got = self.check(frame(spark, [(n, "one two", "en", "a") for n in range(4)] + [(9, "", "en", "b")]))
        assert {row[:3] for row in got} == {("en", "a", "pair"), ("en", "b", "pair")}

    def test_runs_cover_the_block(self):
        rows = [([{"source": "a", "n": 2}], 3), ([{"source": "a", "n": 2}, {"source": "b", "n": 1}], 2), ([{"source": "b", "n": 1}], 1)]
        block = divergence.encoded("en", 0, rows).to_pylist()[0]
        assert block["terms"] == 6
        assert block["columns"] == [
            {"source": "a", "starts": [0, 5], "counts": [2, 0]},
            {"source": "b", "starts": [0, 3], "counts": [0, 1]},
        ]

    def test_shares_beyond_64_bits(self):
        counts = np.array([0, 10**12, 3 * 10**13], dtype=np.int64)
        assert divergence.shares(counts, 4 * 10**13, 5).tolist() == [1 + SCALE * (int(c) + 1) // (4 * 10**13 + 5) for c in counts]

    def test_share_in_sql_beyond_64_bits(self, spark):
        from pyspark.sql import functions as F

        row = spark.range(1).select(divergence.share(F.lit(3 * 10**13), F.lit(4 * 10**13), F.lit(7)).alias("p")).first()
        assert row["p"] == 1 + SCALE * (3 * 10**13 + 1) // (4 * 10**13 + 7)

    def test_odd_rows(self, odd_docs, no_docs):
        self.check(odd_docs, min_docs=1)
        assert divergence.audit(no_docs).collect() == []


def rankings(docs, items, limit=10):
    parsed = [(doc, Counter(t.translate(LOWER) for t in ALNUM.findall(text or ""))) for doc, text in docs]
    parsed = [(doc, counts) for doc, counts in parsed if counts]
    number, total = len(parsed), sum(sum(c.values()) for _, c in parsed)
    held = Counter(t for _, counts in parsed for t in counts)
    out = []
    for item, text in set(items):
        terms = {t.translate(LOWER) for t in ALNUM.findall(text or "")}
        scores = []
        for doc, counts in parsed:
            m = 10 + 90 * sum(counts.values()) * number // total
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * held[t] + 1))) * (SCALE * counts[t] // (1000 * counts[t] + 8 * m))
                for t in terms
                if t in counts
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scores)[:limit], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=str)


class TestRanking:
    def check(self, spark, docs, items, **options):
        got = ranking.rank_documents(
            frame(spark, docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options
        )
        assert sorted((tuple(r) for r in got.collect()), key=str) == rankings(docs, items, options.get("limit", 10))

    @pytest.mark.parametrize("chunk", [7, 2000])
    def test_random_texts(self, spark, chunk, monkeypatch):
        monkeypatch.setattr(ranking, "BLOCK", 64)
        pick = random.Random(chunk)

        def text(low, high):
            return " ".join(f"T{min(pick.randint(0, 60), pick.randint(0, 200))}" for _ in range(pick.randint(low, high)))

        docs = [(n, text(0, 50)) for n in range(400)]
        docs += [(400 + n, docs[n % 3][1]) for n in range(60)]
        self.check(spark, docs, [(n, text(0, 12)) for n in range(30)], chunk=chunk, limit=5)

    def test_ties_go_to_the_smaller_id(self, spark):
        self.check(spark, [(n, "alpha beta") for n in range(50, 0, -1)] + [(60, "gamma")], [(1, "alpha"), (2, "beta gamma")])

    def test_every_document_with_a_term_of_all(self, spark):
        self.check(spark, [(n, "all") for n in range(5)], [(1, "all"), (2, "none"), (3, None), (4, "")])

    def test_bounds_prune_without_a_change(self):
        pick = random.Random(1)
        items = ranking.Items([(n, " ".join(f"{n % 4}x{pick.randint(0, 20)}" for _ in range(6))) for n in range(40)])
        tree = ranking.ItemTree(items, np.full(len(items.vocabulary), 9), 1000)
        search = ranking.Search(tree, 3)
        entries = []
        for doc in range(1000):
            terms = np.array(sorted(pick.sample(range(len(items.vocabulary)), 5)))
            entries.append((doc, terms, np.array([pick.randint(1, 10**6) for _ in terms])))
        for at in range(0, 1000, 250):
            part = entries[at : at + 250]
            heads = np.cumsum([0, *[len(terms) for _, terms, _ in part]])
            search.add(ranking.DocBlock(tree, [d for d, _, _ in part], heads, np.concatenate([t for _, t, _ in part]), np.concatenate([v for _, _, v in part])))
        for item in range(40):
            wanted = set(items.terms[item].tolist())
            scores = [(-sum(int(tree.weight[t] * v) for t, v in zip(terms, values, strict=True) if t in wanted), False, doc) for doc, terms, values in entries]
            assert search.best[item] == sorted(s for s in scores if s[0] < 0)[:3]
        assert search.scored < 40 * 1000

    def test_sums_beyond_doubles_are_whole(self, monkeypatch):
        items = ranking.Items([(1, "a b"), (2, "a")])
        tree = ranking.ItemTree(items, np.array([1, 2]), 10)
        assert tree.kind is np.float64
        many = ranking.Items([(1, " ".join(f"t{n}" for n in range(900_000)))])
        assert ranking.ItemTree(many, np.ones(900_000, dtype=np.int64), 10**12).kind is np.int64

    def test_long_documents_of_a_large_corpus(self):
        n = np.array([10**7], dtype=np.int64)
        value = ranking.saturated(np.array([3]), n, 10**13, 10**16)
        assert value.tolist() == [SCALE * 3 // (3000 + 8 * (10 + 90 * 10**7 * 10**13 // 10**16))]

    def test_odd_rows(self, spark, odd_docs, no_docs):
        items = [(1, "plain words"), (1, "another text"), (1, "plain words"), (None, "word line"), (3, "ünïcödé ΑΣ")]
        frame_ = spark.createDataFrame([(*item, "x", 1) for item in items], "item_id long, text string, _item string, rank int")
        got = ranking.rank_documents(odd_docs, frame_, limit=3)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
        assert sorted((tuple(r) for r in got.collect()), key=str) == rankings(rows, items, 3)
        assert ranking.rank_documents(no_docs, frame_).collect() == []
        assert ranking.rank_documents(odd_docs, frame_.limit(0)).collect() == []
