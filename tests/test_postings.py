from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions.text import clean_content
from cairnlake.operators import mutations, postings, search
from cairnlake.operators.postings import StoredIndex, TextIndex

DRAWER = "id string, wing string, room string, source_file string, text string"
WORDS = ["the"] * 12 + [f"w{i}" for i in range(40)]


def drawers(spark, seed, count=120):
    pick = random.Random(seed)
    rows = [
        (f"d{n:03}", f"wing{n % 3}", f"room{n % 5}", f"s{n % 4}", " ".join(pick.choices(WORDS, k=pick.randint(1, 25)))) for n in range(count)
    ]
    return rows, spark.createDataFrame(rows, DRAWER)


def asked(spark, seed, count=30):
    pick = random.Random(seed)
    rows = [(f"q{n}", " ".join(pick.choices(WORDS, k=pick.randint(1, 9)))) for n in range(count)] + [("none", ""), ("odd", "zebra w1")]
    return rows, spark.createDataFrame(rows, "query_id string, query string")


def scores(query, rows):
    wanted = set(query.split())
    return {r[0]: len(wanted & set(r[4].split())) / len(wanted) for r in rows} if wanted else {}


@pytest.mark.parametrize("threshold,limit", [(0.05, 3), (0.5, 4), (0.67, 100), (1.0, 2)])
def test_best_matches_equal_brute_force(spark, threshold, limit, monkeypatch):
    monkeypatch.setattr(postings, "PART_ROWS", 7)
    rows, df = drawers(spark, 1)
    queries, qf = asked(spark, 2)
    got = {(r["query_id"], r["place"], r["id"]) for r in postings.best_matches(qf, TextIndex.of(df), threshold, limit).collect()}
    expected = set()
    for name, query in queries:
        best = sorted((-s, i) for i, s in scores(query, rows).items() if s >= threshold)
        expected |= {(name, place, i) for place, (_, i) in enumerate(best[:limit], 1)}
    assert got == expected


@pytest.mark.parametrize("scope", [{}, {"wing": "wing1"}, {"wing": "wing0", "room": "room2"}])
@pytest.mark.parametrize("query,limit", [("the w1 w2 w3", 5), ("the w5", 40), ("w1 nothing", 3), ("nothing", 4), ("", 6), ("the w1 w2 w3 w4 w5 w6", 2)])
def test_search_equals_the_scan(spark, query, limit, scope):
    _, df = drawers(spark, 3, 80)
    wanted = [(r["id"], r["similarity"]) for r in search.lexical_search(df, query, limit, **scope).collect()]
    got = [(r["id"], r["similarity"]) for r in postings.search_index(TextIndex.of(df), query, limit, **scope).collect()]
    assert got == wanted


def test_stored_index_follows_changes(spark, tmp_path):
    rows, df = drawers(spark, 4, 40)
    stored = StoredIndex(spark, str(tmp_path / "index"))
    stored.add(df)
    stored.add(spark.createDataFrame([("d001", "wing9", "r", "s", "brand new text"), ("x", "w", "r", "s", "brand w1")], DRAWER))
    stored.delete(spark.createDataFrame([("d000",), ("d002",)], "id string"))
    now = [r for r in rows if r[0] not in ("d000", "d001", "d002")] + [("d001", "wing9", "r", "s", "brand new text"), ("x", "w", "r", "s", "brand w1")]
    index = stored.open()
    for _ in range(2):
        for query in ("brand new", "the w1 w2", "w3"):
            fresh = search.lexical_search(spark.createDataFrame(now, DRAWER), query, 7).collect()
            assert [r["id"] for r in postings.search_index(index, query, 7).collect()] == [r["id"] for r in fresh]
        stored.compact()
        index = stored.open()
    assert index.postings.count() == sum(len(set(r[4].split())) for r in now)


def test_postings_of_a_change_that_stopped_are_not_read(spark, tmp_path, monkeypatch):
    stored = StoredIndex(spark, str(tmp_path / "index"))
    _, df = drawers(spark, 5, 20)
    stored.add(df)
    before = stored.open().postings.count()

    def stop(*_, **__):
        raise OSError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(stored.docs, "commit", stop)
        with pytest.raises(OSError):
            stored.add(spark.createDataFrame([("late", "w", "r", "s", "late text")], DRAWER))
    assert stored.open().postings.count() == before
    stored.add(spark.createDataFrame([("later", "w", "r", "s", "later text")], DRAWER))
    assert stored.open().postings.count() == before + 2


def judged(requests, stored, threshold):
    """Outcomes one after the other, as a single writer gives them."""
    held = {i: set(t.split()) for i, t in stored}
    out = {}
    for _, i, text in sorted(requests):
        wanted = set(text.split())
        hits = sum(len(wanted & tokens) / len(wanted) >= threshold for tokens in held.values()) if wanted else 0
        if i in {s for s, _ in stored}:
            out[i] = ("noop", 0)
        elif hits:
            out[i] = ("duplicate", min(5, hits))
        else:
            out[i] = ("inserted", 0)
            held[i] = wanted
    return out


@pytest.mark.parametrize("seed,threshold", [(1, 0.5), (2, 0.67), (3, 0.9), (4, 1.0)])
def test_a_batch_is_judged_against_itself(spark, seed, threshold):
    pick = random.Random(seed)
    few = [f"w{n}" for n in range(9)]
    stored = [(f"s{n}", " ".join(pick.choices([*few, "zz"], k=4))) for n in range(4)]
    requests = [(pick.randint(0, 20), f"r{n:02}", " ".join(pick.choices(few, k=pick.randint(0, 5)))) for n in range(60)] + [(3, "s1", "w1")]
    sf = spark.createDataFrame([(i, "w", "r", "f", t) for i, t in stored], DRAWER)
    rf = spark.createDataFrame([(i, "w", "r", "f", t, o) for o, i, t in requests], f"{DRAWER}, ord int")
    got = {r["id"]: (r["outcome"], r["matches"]) for r in mutations.add_outcomes(sf, rf, threshold).collect()}
    assert got == judged(requests, stored, threshold)


def test_requests_that_differ_by_a_full_stop_are_inserted_once(spark):
    rows = [("b", "w", "r", "f", "one two three."), ("a", "w", "r", "f", "one two three")]
    empty = spark.createDataFrame([], DRAWER)
    got = {r["id"]: r["outcome"] for r in mutations.add_outcomes(empty, spark.createDataFrame(rows, DRAWER)).collect()}
    assert got == {"a": "inserted", "b": "duplicate"}
    assert mutations.add_outcomes(empty, empty).withColumn("x", F.lit(1)).count() == 0


def test_stored_texts_of_an_add_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    stored = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "delta epsilon")], "id string, text string")
    asked = [("a", "w", "r", "alpha beta gamma"), ("c", "w", "r", "delta epsilon"), ("d", "w", "r", "zeta eta")]
    requests = spark.createDataFrame(asked, "id string, wing string, room string, text string")
    outcomes = mutations.add_outcomes(stored.mapInArrow(count, stored.schema), requests)
    assert {(r["id"], r["outcome"], r["matches"]) for r in outcomes.collect()} == {("a", "noop", 0), ("c", "duplicate", 1), ("d", "inserted", 0)}
    assert made.value == 2


def test_line_endings_of_cleaned_content(spark):
    texts = ["a\r\nb\rc\r\r\nd\n\re\r", "\r\n", "a\x07\r\n\x00b", "", None]
    rows = spark.createDataFrame([(text,) for text in texts], "t string").select(clean_content(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["a\nb\nc\n\nd\n\ne", "", "a\nb", "", None]
