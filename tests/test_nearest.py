from __future__ import annotations

import random

import numpy as np
import pytest

from cairnlake.operators import nearest, vectors
from cairnlake.operators.nearest import NearestIndex


def frames(spark, seed, stored=400, asked=40):
    """Clustered vectors with ties and repeats, and queries near and far."""
    pick = random.Random(seed)
    spots = [[pick.uniform(-5, 5) for _ in range(6)] for _ in range(8)]
    rows = []
    for n in range(stored):
        spot = pick.choice(spots)
        rows.append((n, [float(np.float32(x + pick.gauss(0, 0.2))) for x in spot] if n % 5 else [float(np.float32(x)) for x in spots[0]]))
    queries = [(f"q{n}", [x + pick.gauss(0, 0.5) for x in pick.choice(spots)]) for n in range(asked)] + [("far", [90.0] * 6)]
    return rows, queries, spark.createDataFrame(rows, "id long, embedding array<float>"), spark.createDataFrame(queries, "query_id string, embedding array<double>")


def brute(rows, queries, limit):
    out = set()
    for name, query in queries:
        order = sorted((float(np.square(np.array(v) - np.array(query)).sum()), n) for n, v in rows)
        out |= {(name, place, n) for place, (_, n) in enumerate(order[:limit], 1)}
    return out


@pytest.mark.parametrize("lists,part_rows,limit", [(1, 1000, 3), (12, 30, 5), (400, 7, 1), (12, 30, 500)])
def test_index_search_equals_brute_force(spark, lists, part_rows, limit):
    rows, queries, stored, asked = frames(spark, lists)
    index = nearest.build_index(stored, lists, part_rows=part_rows)
    got = nearest.index_knn(asked, index, limit, block_rows=11).collect()
    assert {(r["query_id"], r["place"], r["id"]) for r in got} == brute(rows, queries, limit)


def test_rings_out_of_reach_are_not_read(spark):
    _, _, stored, asked = frames(spark, 3)
    share = nearest.visited_share(asked, nearest.build_index(stored, 12), 3).first()
    assert share["pairs"] < share["all_pairs"] / 3


def test_saved_index_gives_the_same_rows(spark, tmp_path):
    rows, queries, stored, asked = frames(spark, 5)
    nearest.build_index(stored, 9).save(str(tmp_path / "index"))
    got = nearest.index_knn(asked, NearestIndex.load(spark, str(tmp_path / "index")), 4).collect()
    assert {(r["query_id"], r["place"], r["id"]) for r in got} == brute(rows, queries, 4)


def test_empty_and_missing_vectors(spark):
    _, _, stored, asked = frames(spark, 7)
    assert nearest.index_knn(asked, nearest.build_index(stored.limit(0)), 2).count() == 0
    with_null = stored.limit(3).unionByName(spark.createDataFrame([(99, None)], stored.schema))
    got = nearest.index_knn(asked.limit(1), nearest.build_index(with_null), 5).collect()
    assert len(got) == 3 and 99 not in {r["id"] for r in got}


@pytest.mark.parametrize("limit", [1, 3, 500])
def test_block_join_equals_brute_force_and_leaves_missing_vectors_out(spark, limit):
    rows, queries, stored, asked = frames(spark, 11)
    with_null = stored.unionByName(spark.createDataFrame([(9999, None)], stored.schema))
    got = vectors.knn_join(asked, with_null, limit, block_rows=90).collect()
    assert {(r["query_id"], r["place"], r["id"]) for r in got} == brute(rows, queries, limit)


def test_products_that_round_away_small_gaps_keep_the_nearest_rows():
    stored = np.array([[1e6 + gap, -1e6] for gap in (3e-4, 1e-4, 2e-4, 1e-4)])
    rows, at, distances = vectors.nearest_rows(np.array([[1e6, -1e6]]), stored, np.array([4, 3, 2, 1]), 2)
    assert (rows.tolist(), at.tolist()) == ([0, 0], [3, 1]) and distances[0] == distances[1]


def test_encoders_get_few_texts_at_a_time(spark):
    def encode(texts):
        assert len(texts) <= vectors.ENCODED_ROWS
        return np.array([[len(text), 1.0] for text in texts])

    texts = spark.createDataFrame([(n, "x" * (n % 7)) for n in range(700)], "id int, text string").coalesce(1)
    got = vectors.embed(texts, encoder=encode).collect()
    assert sorted((r["id"], r["embedding"]) for r in got) == [(n, [float(n % 7), 1.0]) for n in range(700)]
    assert vectors.embed(texts.limit(0), encoder=encode).count() == 0
