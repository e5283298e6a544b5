from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.functions import arrays, params
from cairnlake.functions import text as tx
from cairnlake.functions.ordered import next_value, running_sum


@pytest.mark.parametrize(
    "text, expected",
    [
        ("étion café foo_1 bär", ["foo_1"]),
        ("The JWT, the token!", ["the", "jwt", "the", "token"]),
        ("", []),
        ("x-y 42 ÀB", ["x", "y", "42"]),
    ],
)
def test_tokens_are_whole_ascii_words(value, text, expected):
    assert value(tx.tokens, text) == expected


@pytest.mark.parametrize("number, expected", [(0.0625, 0.062), (0.0635, 0.064), (2 / 3, 0.667), (0.5, 0.5)])
def test_rounding_is_half_even(spark, number, expected):
    assert spark.range(1).select(tx.half_even(F.lit(number), 3)).first()[0] == expected


def test_trim_removes_all_white_space(value):
    assert value(tx.trim, "   \t text \n　") == "text"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("My Wing / Notes", "my_wing_notes"),
        ("__A--b..c__", "a-b..c"),
        ("Größe", "gr_e"),
        ("///", ""),
    ],
)
def test_slug(value, text, expected):
    # Separators next to each other collapse into one.
    assert value(tx.slug, text) == expected


@pytest.mark.parametrize("text, ok", [("2024-02-29", True), ("2024-2-9", False), ("2023-02-29", False), ("x", False)])
def test_iso_date_is_strict(value, text, ok):
    assert (value(tx.iso_date, text) == text) is ok


def test_ids_and_names(value):
    assert value(tx.entity_id, "Alice O'Neil") == "alice_oneil"
    assert value(tx.predicate_id, "Works At") == "works_at"
    assert value(tx.wing_name, "My-New App") == "my_new_app"
    assert value(tx.agent_wing, "Night Owl") == "wing_night_owl"
    assert value(lambda c: tx.mined_id(F.lit("w"), F.lit("r"), c, F.lit(0)), "/a/b.md").startswith("drawer_w_r_")
    assert value(tx.estimated_tokens, "a b c d e f g h") == 10
    assert value(tx.estimated_tokens, "") == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=30))
def test_bag_counts_like_a_counter(spark, words):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(arrays.bag(F.col("w"))).first()[0] == dict(Counter(words))


def test_cosine_and_containment(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"])], "l array<string>, r array<string>")
    left, right = arrays.bag(F.col("l")), arrays.bag(F.col("r"))
    row = df.select(
        arrays.bag_cosine(left, arrays.bag_norm(left), right, arrays.bag_norm(right)),
        arrays.containment(F.array_distinct("l"), F.col("r")),
        arrays.containment(F.array().cast("array<string>"), F.col("r")),
    ).first()
    assert row[0] == pytest.approx(2 / math.sqrt(5 * 2))
    assert row[1] == 0.5
    assert row[2] == 0.0


def test_last_n_keeps_short_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6],)], "v array<int>")
    assert [r[0] for r in df.select(arrays.last_n(F.col("v"), 5)).collect()] == [[1, 2, 3], [2, 3, 4, 5, 6]]


def test_running_sum_and_next_value_do_not_depend_on_blocks(spark):
    rows = [("hot", i, i % 3) for i in range(200)] + [("cold", i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for size in (1, 7, 1000):
        block = F.floor(F.col("i") / size)
        got = running_sum(df, ["k"], ["i"], block, F.col("v"), "s").collect()
        for row in got:
            assert row["s"] == sum(v for k, i, v in rows if k == row["k"] and i <= row["i"])
        following = next_value(df, ["k"], ["i"], block, "i", "n").collect()
        for row in following:
            last = 199 if row["k"] == "hot" else 4
            assert row["n"] == (None if row["i"] == last else row["i"] + 1)


def test_parameter_rules():
    assert params.clamp_positive(0, (5, 25)) == 5
    assert params.clamp_positive(None, (5, 25)) == 5
    assert params.clamp_positive(99, (5, 25)) == 25
    assert params.clamp_threshold(float("nan")) == 0.9
    assert params.clamp_threshold(-1) == 0.0
    assert params.clamp_threshold(2) == 1.0
    assert [params.parse_switch(w) for w in ("Yes", "off", "maybe", None)] == [True, False, None, None]


def test_content_cleaning(value):
    assert value(tx.clean_content, " a\r\nb\rc\x07 ") == "a\nb\nc"
    assert value(tx.display_name, "  Ada \t Byron\x00 ") == "Ada Byron"
    assert value(lambda c: tx.count_occurrences(c, F.lit("aa")), "aaaa aa") == 3
    assert re.fullmatch(r"[0-9a-f]{24}", value(lambda c: tx.diary_id(c, F.lit("t"), F.lit("e")), "w").rsplit("_", 1)[1])
