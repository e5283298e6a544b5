"""Rule-based memory extraction: segments, prose filter, marker scores, sentiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import lexicons as lex
from cairnlake.functions.arrays import groups_from, positions
from cairnlake.functions.partitions import posexplode_rows
from cairnlake.functions.text import let, lines_of, may_match, string_array, trim
from cairnlake.operators.chunking import line_groups, paragraphs

# Fixed rules.
MIN_SEGMENT = 20
MIN_CONFIDENCE = 0.3
FULL_SCORE = 5.0
TURNS_TO_SPLIT = 3
# Unicode classes, and a dot that stops at \n only.
FLAGS = "(?Ud)"


def _matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(FLAGS + pattern) for pattern in patterns])


def is_speaker_line(line: Column) -> Column:
    return _matches_any(trim(line), lex.SPEAKER_LINES)


def segments(text: Column) -> Column:
    """Speaker turns when three lines open one, else paragraphs, else groups of lines."""

    def choose(lines: Column) -> Column:
        def by_turn(starts: Column) -> Column:
            opened = F.when(F.get(starts, F.lit(0)) > 0, F.array_insert(starts, 1, F.lit(0))).otherwise(starts)
            return let(opened, lambda at: F.transform(groups_from(lines, at), lambda g: F.array_join(g, "\n")))

        other = let(
            paragraphs(text),
            lambda found: F.when(
                (F.size(found) <= 1) & (F.size(lines) > 20), F.filter(line_groups(text), lambda g: g != "")
            ).otherwise(found),
        )
        return let(
            positions(lines, is_speaker_line),
            lambda starts: F.when(F.size(starts) >= TURNS_TO_SPLIT, by_turn(starts)).otherwise(other),
        )

    return let(lines_of(text), choose)


def is_code_line(line: Column) -> Column:
    """A trimmed line that looks like code: a pattern hit, or long with few letters."""

    def test(stripped: Column) -> Column:
        letters = F.length(F.regexp_replace(stripped, r"\P{L}+", ""))
        sparse = (letters / F.greatest(F.length(stripped), F.lit(1)) < 0.4) & (F.length(stripped) > 10)
        return (stripped != "") & (_matches_any(stripped, lex.CODE_LINES) | sparse)

    return let(trim(line), test)


def prose(text: Column) -> Column:
    """Text without fenced blocks and code lines; the text itself when nothing is left.

    Cutting at the fence lines leaves the parts outside fences at the even places.
    """
    fences = F.split(text, r"(?m)^[^\S\n]*```[^\n]*(?:\n|\z)", -1)
    parts = F.when(F.contains(text, F.lit("```")), fences).otherwise(F.array(text))
    # A part that a fence closes ends with the line break of its last line.
    outside = F.filter(
        F.transform(parts, lambda part, i: F.when(i % 2 == 0, F.regexp_replace(part, r"\n\z", ""))),
        lambda part: part.isNotNull() & (part != ""),
    )
    kept = F.filter(F.flatten(F.transform(outside, lines_of)), lambda line: ~is_code_line(line))
    return let(trim(F.array_join(kept, "\n")), lambda found: F.when(F.length(found) > 0, found).otherwise(text))


def marker_score(lowered: Column, markers: list[str]) -> Column:
    """Non-overlapping hits of all patterns; a pattern is only run on texts that hold its literals."""

    def hits(marker: str) -> Column:
        return F.when(~may_match(lowered, marker), 0).otherwise(F.regexp_count(lowered, F.lit(FLAGS + marker)))

    return reduce(lambda a, b: a + b, map(hits, markers))


def sentiment(
    text: Column, positive: list[str] = lex.POSITIVE_WORDS, negative: list[str] = lex.NEGATIVE_WORDS
) -> Column:
    """positive / negative / neutral by the number of distinct words of each list."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0)))

    def decide(found: Column) -> Column:
        good = F.size(F.array_intersect(found, string_array(positive)))
        bad = F.size(F.array_intersect(found, string_array(negative)))
        return F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")

    return let(words, decide)


def has_resolution(text: Column) -> Column:
    return _matches_any(F.lower(text), lex.RESOLUTION_PATTERNS)


def _disambiguated(kind: Column, text: Column, score: dict[str, Column], mood: Column) -> Column:
    """A resolved or cheerful problem is really a milestone or an emotional memory."""
    problem = kind == "problem"
    emotional = score.get("emotional", F.lit(0)) > 0
    milestone = score.get("milestone", F.lit(0)) > 0
    cheerful = mood == "positive"
    return (
        F.when(problem & has_resolution(text), F.when(emotional & cheerful, "emotional").otherwise("milestone"))
        .when(problem & cheerful & milestone, "milestone")
        .when(problem & cheerful & emotional, "emotional")
        .otherwise(kind)
    )


def memory_scores(lowered: Column, markers: dict[str, list[str]] = lex.MEMORY_MARKERS) -> Column:
    """Struct with one score per memory type."""
    return let(lowered, lambda text: F.struct(*[marker_score(text, patterns).alias(kind) for kind, patterns in markers.items()]))


def memory_of(
    segment: Column,
    markers: dict[str, list[str]] = lex.MEMORY_MARKERS,
    positive: list[str] = lex.POSITIVE_WORDS,
    negative: list[str] = lex.NEGATIVE_WORDS,
) -> Column:
    """``struct<content, memory_type, confidence>`` of a segment, NULL without any marker.

    The type is the best score, ties in declaration order.
    """
    kinds = list(markers)

    def from_prose(text: Column) -> Column:
        def from_scores(scores: Column) -> Column:
            score = {kind: scores[kind] for kind in kinds}
            best = F.greatest(*score.values()) if len(kinds) > 1 else score[kinds[0]]
            kind = F.coalesce(*[F.when(score[name] == best, F.lit(name)) for name in kinds])
            bonus = F.when(F.length(segment) > 500, 2).when(F.length(segment) > 200, 1).otherwise(0)
            return F.when(
                best > 0,
                F.struct(
                    trim(segment).alias("content"),
                    _disambiguated(kind, text, score, sentiment(text, positive, negative)).alias("memory_type"),
                    F.least(F.lit(1.0), (best + bonus) / FULL_SCORE).alias("confidence"),
                ),
            )

        return let(memory_scores(F.lower(text), markers), from_scores)

    return F.when(F.length(trim(segment)) >= MIN_SEGMENT, let(prose(segment), from_prose))


def extract_memories(
    df: DataFrame,
    text: str = "text",
    min_confidence: float = MIN_CONFIDENCE,
    markers: dict[str, list[str]] = lex.MEMORY_MARKERS,
    positive: list[str] = lex.POSITIVE_WORDS,
    negative: list[str] = lex.NEGATIVE_WORDS,
) -> DataFrame:
    """One row per memory: the columns of ``df`` without ``text``, then index, content, type, confidence."""
    kept = [name for name in df.columns if name != text]
    found = F.filter(
        F.transform(segments(F.col(text)), lambda s: memory_of(s, markers, positive, negative)),
        lambda m: m.isNotNull() & (m["confidence"] >= min_confidence),
    )
    return posexplode_rows(df, found, "chunk_index", "memory", *kept).select(*kept, "chunk_index", "memory.*")
