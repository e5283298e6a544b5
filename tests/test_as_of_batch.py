"""The batch as-of join against a plain comparison of every fact with every day."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import knowledge

FACTS = "subject string, predicate string, object string, valid_from string, valid_to string"
DAYS = [None, "2023-12-31", "2024-01-01", "2024-02-15", "2024-02-29", "2024-12-31", "2025-07-01", "0000-01-01", "9999-12-31", "2024-13-01", "soon", ""]


def _day(rng: random.Random) -> str | None:
    return rng.choice(DAYS) if rng.random() < 0.3 else f"{rng.randint(2020, 2026)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"


def _plain(facts, probes):
    return sorted(
        (str(f), day)
        for f in facts
        for subject, day in probes
        if subject == f[0] and day is not None and (f[3] is None or f[3] <= day) and (f[4] is None or f[4] >= day)
    )


@pytest.mark.parametrize("hot_facts", [0, 50, 10_000])
def test_the_cut_changes_no_row(spark, hot_facts):
    rng = random.Random(7)
    subjects = ["hot"] * 6 + ["warm", "cold", None]
    facts = [(rng.choice(subjects), "p", f"o{i % 40}", _day(rng), _day(rng)) for i in range(400)]
    facts += facts[:20]
    probes = [(rng.choice(subjects), _day(rng)) for _ in range(80)] + [("hot", d) for d in DAYS] + [("nobody", "2024-01-01")]
    df = spark.createDataFrame(facts, FACTS)
    asked = spark.createDataFrame(probes, "subject string, day string")
    got = knowledge.as_of_batch(df, asked, hot_facts).collect()
    kept = [f for f in facts if f[0] is not None]
    assert sorted((str(tuple(r)[:5]), r["day"]) for r in got) == _plain(kept, probes)


def test_empty_sides(spark):
    none = spark.createDataFrame([], FACTS)
    asked = spark.createDataFrame([("a", "2024-01-01")], "subject string, day string")
    one = spark.createDataFrame([("a", "p", "o", None, None)], FACTS)
    for hot_facts in (0, 10):
        assert knowledge.as_of_batch(none, asked, hot_facts).count() == 0
        assert knowledge.as_of_batch(one, asked.limit(0), hot_facts).count() == 0
        assert knowledge.as_of_batch(one, asked, hot_facts).columns == ["subject", "predicate", "object", "valid_from", "valid_to", "day"]


def test_a_hot_subject_is_dealt_over_spans_and_pieces(spark):
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 2000), "yyyy-MM-dd")
    later = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 2000 + 9), "yyyy-MM-dd")
    facts = spark.range(20_000).select(
        F.lit("hot").alias("subject"), F.lit("p").alias("predicate"), F.concat(F.lit("o"), F.col("id")).alias("object"), day.alias("valid_from"), later.alias("valid_to")
    )
    asked = facts.where("object IN ('o5', 'o700')").select("subject", F.col("valid_from").alias("day"))
    got = knowledge.as_of_batch(facts, asked, 1_000).groupBy("day").count().collect()
    assert {r["day"]: r["count"] for r in got} == {"2020-01-06": 60, "2021-12-01": 100}
