"""Detection of people and projects by name patterns in text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import lexicons as lex
from cairnlake.functions.arrays import bag
from cairnlake.functions.partitions import explode_rows
from cairnlake.functions.text import half_even, let, lines_of, may_match, stem, string_array

# Fixed rules.
MIN_FREQUENCY = 3
CAPS = {"person": 15, "project": 10, "uncertain": 8}
# The look ahead changes no match; it spares most places the costly test for a word boundary.
# Nor do the possessive loops, as no shorter loop ends at a boundary that the whole one lacks, but a greedy
# one takes a stack frame per word and ends the executor on a run of some 2,000 capitalised words.
WORD_NAME = r"(?U)(?=[A-Z])\b[A-Z][a-z]{1,19}\b"
PHRASE_NAME = r"(?U)(?=[A-Z])\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++\b)++"
CAMEL_NAME = r"(?U)(?=[A-Z])\b[A-Z][a-z]++(?:[A-Z][a-z]++)++\b"


def name_candidates(
    text: Column, stopwords: Iterable[str] = lex.NAME_STOPWORDS, camel_case: bool = True
) -> Column:
    """Every occurrence of a capitalised word, phrase or joined word that is not a stopword."""
    stop = list(stopwords)

    def known(word: Column) -> Column:
        return F.lower(word).isin(stop)

    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    words = F.filter(all_of(WORD_NAME), lambda word: ~known(word))
    phrases = F.filter(all_of(PHRASE_NAME), lambda phrase: ~F.exists(F.split(phrase, " +"), known))
    if not camel_case:
        return F.concat(words, phrases)
    return F.concat(words, phrases, F.filter(all_of(CAMEL_NAME), lambda word: ~known(word)))


def candidate_counts(
    texts: DataFrame,
    text: str = "text",
    keys: Iterable[str] = (),
    stopwords: Iterable[str] = lex.NAME_STOPWORDS,
    camel_case: bool = True,
    minimum: int = MIN_FREQUENCY,
) -> DataFrame:
    """``(keys, name, frequency)`` of names seen at least ``minimum`` times, combined before the shuffle."""
    keys = list(keys)
    names = explode_rows(texts, name_candidates(F.col(text), list(stopwords), camel_case), "name", *keys)
    return names.groupBy(*keys, "name").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= minimum)


def near_pronoun(lines: Column) -> Column:
    """Lower-cased lines whose five-line frame holds a pronoun.

    The frame starts two lines above, but never before the first line, and always
    spans five lines.
    """

    def frame(marks: Column, lowered: Column) -> Column:
        def keep(line: Column, i: Column) -> Column:
            return F.array_contains(F.slice(marks, F.greatest(i - 2, F.lit(0)) + 1, F.lit(5)), True)

        return F.filter(lowered, keep)

    return let(
        F.transform(lines, F.lower),
        lambda lowered: let(
            F.transform(lowered, lambda line: line.rlike("(?U)(?=[hst])" + lex.PRONOUNS)), lambda marks: frame(marks, lowered)
        ),
    )


# How a template is read without knowing the name: where the name stands and what must follow.
def _slot_pattern(template: str) -> str:
    """Turn a name template into a pattern that captures any single word in the name's place.

    What follows the name, and the name itself after a leading phrase, is only looked
    at, so one pass finds every word that stands in such a slot.
    """
    if template.startswith(r"\bhey") and "|" in template:
        template = r"\b(?:hey|thanks?|hi)\s+{name}\b"
    head, tail = template.split("{name}")
    if head in (r"\b", "^", r"^>\s*", r"^\[", '"'):
        tail = tail.removeprefix(r"\b")
        return f"(?Umd){head}(\\w++)(?={tail})" if tail else f"(?Umd){head}(\\w++)"
    lead, space = re.fullmatch(r"(.*?)(\\s\+)", head).groups()
    return f"(?Umd){lead}(?={space}(\\w++){tail if tail != chr(92) + 'b' else ''})"


SIGNALS = [
    *[("dialogue", template, 3) for template in lex.DIALOGUE_SLOTS],
    *[("action", template, 2) for template in lex.ACTION_SLOTS],
    *[("addressed", template, 4) for template in lex.ADDRESS_SLOTS],
    *[("project", template, 2) for template in lex.PROJECT_SLOTS],
    *[("versioned", template, 3) for template in lex.VERSION_SLOTS],
    *[("code", template, 3) for template in lex.CODE_FILE_SLOTS],
]


def _found(text: Column, pattern: str, template: str, group: int) -> Column:
    """All captures of a pattern, which is only run on texts that hold the literals of its template."""
    captures = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(may_match(text, template.replace("{name}", r"\w+")), captures).otherwise(string_array([]))


def _version_slots(text: Column) -> Column:
    """Words before a hyphen, and every beginning of a word that is followed by ``v`` and more."""
    hyphen = _found(text, r"(?U)\b(\w++)(?=-\w)", "-", 1)
    joined = F.regexp_extract_all(text, F.lit(r"(?U)\b\w+v\w+"), F.lit(0))

    def beginnings(word: Column) -> Column:
        places = F.sequence(F.lit(2), F.length(word) - 1)
        cut = F.filter(places, lambda at: F.substring(word, at, F.lit(1)) == "v")
        return F.transform(cut, lambda at: F.substring(word, F.lit(1), at - 1))

    return F.concat(hyphen, F.flatten(F.transform(joined, beginnings)))


def signal_words(text: Column) -> Column:
    """For every signal, the words of a lower-case text standing in its name slot: ``array<array<string>>``."""
    found = [
        _version_slots(text)
        if kind == "versioned"
        else _found(text, _slot_pattern(template), template, 1)
        for kind, template, _ in SIGNALS
    ]
    return F.array(*found)


def _held_templates(text: Column, lowered: Column) -> Column:
    """For every signal, whether a text holds the literals of its template.

    Beyond the letters that lower case to them, a pattern without case takes these three for i and s.
    """
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(letter)) for letter in "İıſ"])
    folded = F.when(odd, F.lower(F.translate(text, "İıſ", "iis"))).otherwise(lowered)
    return let(folded, lambda low: F.array(*[may_match(low, template.replace("{name}", r"\w+")) for _, template, _ in SIGNALS]))


def _phrase_hits(text: Column, name: Column, held: Column) -> Column:
    """Signal counts of a name of several words, with the name put into each template that is ``held``."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    counts = [
        F.regexp_count(text, F.concat(F.lit("(?iUmd)"), F.replace(F.lit(template), F.lit("{name}"), quoted)))
        for _, template, _ in SIGNALS
    ]
    return F.array(*[F.when(F.get(held, F.lit(i)), count).otherwise(0) for i, count in enumerate(counts)])


def _name_hits(
    texts: DataFrame,
    text: str = "text",
    key: str = "id",
    stopwords: Iterable[str] = lex.NAME_STOPWORDS,
    camel_case: bool = True,
    minimum: int = MIN_FREQUENCY,
) -> DataFrame:
    """Signal counts per text and name: ``(key, name, frequency, hits, pronouns)``.

    One pass per pattern collects the words in its name slot, and one map of their counts
    is looked up for every name; only names of several words are matched one by one.
    Everything happens inside the row of a text: no shuffle.
    """
    counts = F.map_entries(bag(name_candidates(F.col(text), list(stopwords), camel_case)))
    named = texts.select(
        key, F.col(text).alias("_text"), F.filter(counts, lambda e: e["value"] >= minimum).alias("_names")
    )

    def is_phrase(name: Column) -> Column:
        return name["key"].rlike(r"\s")

    def judged(text: Column, scanned: Column) -> Column:
        def hits(name: Column) -> Column:
            lowered = F.lower(name["key"])
            single = F.transform(scanned["slots"], lambda counts: F.coalesce(F.try_element_at(counts, lowered), F.lit(0)).cast("int"))
            found = F.when(is_phrase(name), _phrase_hits(text, name["key"], scanned["held"])).otherwise(single)
            pronouns = F.size(F.filter(scanned["framed"], lambda line: F.contains(line, lowered)))
            return F.struct(name["key"].alias("name"), name["value"].alias("frequency"), found.alias("hits"), pronouns.alias("pronouns"))

        return F.transform("_names", hits)

    def scan(low: Column) -> Column:
        held = F.when(F.exists("_names", is_phrase), _held_templates(F.col("_text"), low))
        return F.struct(F.transform(signal_words(low), bag).alias("slots"), near_pronoun(lines_of(F.col("_text"))).alias("framed"), held.alias("held"))

    scanned = let(F.lower("_text"), scan)
    # Names are judged inside the row, so that a text is not copied for each of its names.
    found = F.when(F.size("_names") > 0, let(scanned, lambda kept: judged(F.col("_text"), kept)))
    return explode_rows(named, found, "_hit", key).select(key, "_hit.*")


def score_names(texts: DataFrame, text: str = "text", key: str = "id", **options) -> DataFrame:
    """Person and project evidence per text and name.

    Returns ``(key, name, frequency, person_score, project_score, person_signals,
    project_signals)``; options are those of the candidates and their ``minimum``.
    """
    return _weighed(_name_hits(texts, text, key, **options), key)


def _weighed(scored: DataFrame, *keys: str) -> DataFrame:
    """Scores and signal texts of counted hits."""
    labels = {
        "dialogue": lambda n: F.format_string("dialogue marker (%dx)", n),
        "action": lambda n: F.format_string("'%s ...' action (%dx)", F.col("name"), n),
        "addressed": lambda n: F.format_string("addressed directly (%dx)", n),
        "project": lambda n: F.format_string("project verb (%dx)", n),
        "versioned": lambda n: F.format_string("versioned/hyphenated (%dx)", n),
        "code": lambda n: F.format_string("code file reference (%dx)", n),
    }

    def weigh(kinds: tuple[str, ...]) -> tuple[Column, list[Column]]:
        total, signals = F.lit(0), []
        for i, (kind, _, weight) in enumerate(SIGNALS):
            if kind in kinds:
                n = F.get("hits", F.lit(i))
                total = total + n * weight
                signals.append(F.when(n > 0, labels[kind](n)))
        return total, signals

    def first_three(signals: list[Column]) -> Column:
        return F.slice(F.filter(F.array(*signals), lambda s: s.isNotNull()), 1, 3)

    spoken, spoken_signals = weigh(("dialogue", "action"))
    addressed, addressed_signals = weigh(("addressed",))
    project, project_signals = weigh(("project", "versioned", "code"))
    nearby = F.when(F.col("pronouns") > 0, F.format_string("pronoun nearby (%dx)", F.col("pronouns")))
    return scored.select(
        *keys,
        "name",
        "frequency",
        (spoken + F.col("pronouns") * 2 + addressed).alias("person_score"),
        project.alias("project_score"),
        first_three([*spoken_signals, nearby, *addressed_signals]).alias("person_signals"),
        first_three(project_signals).alias("project_signals"),
    )


def classify_names(scores: DataFrame) -> DataFrame:
    """Add ``type``, ``confidence`` and ``signals`` to scored names."""
    total = F.col("person_score") + F.col("project_score")
    ratio = F.col("person_score") / total.cast("double")

    def mentions(word: str) -> Column:
        return F.exists("person_signals", lambda s: F.contains(s, F.lit(word))).cast("int")

    kinds = [mentions(word) for word in ("dialogue", "action", "pronoun", "addressed")]
    seen = F.format_string("appears %dx", F.col("frequency"))
    nothing = total == 0
    person = (ratio >= 0.7) & (sum(kinds[1:], kinds[0]) >= 2) & (F.col("person_score") >= 5)
    leaning = ratio >= 0.7
    project = ratio <= 0.3
    dash = "—"
    return scores.select(
        "*",
        F.when(nothing, "uncertain").when(person, "person").when(leaning, "uncertain").when(project, "project").otherwise("uncertain").alias("type"),
        F.when(nothing, half_even(F.least(F.lit(0.4), F.col("frequency") / 50.0), 2))
        .when(person, half_even(F.least(F.lit(0.99), 0.5 + ratio * 0.5), 2))
        .when(leaning, F.lit(0.4))
        .when(project, half_even(F.least(F.lit(0.99), 0.5 + (1 - ratio) * 0.5), 2))
        .otherwise(F.lit(0.5))
        .alias("confidence"),
        F.when(nothing, F.array(F.concat(seen, F.lit(", no strong type signals"))))
        .when(person, F.col("person_signals"))
        .when(leaning, F.concat("person_signals", F.array(F.concat(seen, F.lit(f" {dash} pronoun-only match")))))
        .when(project, F.when(F.size("project_signals") > 0, F.col("project_signals")).otherwise(F.array(seen)))
        .otherwise(
            F.concat(
                F.slice(F.concat("person_signals", "project_signals"), 1, 3),
                F.array(F.lit(f"mixed signals {dash} needs review")),
            )
        )
        .alias("signals"),
    )


def detect_names(texts: DataFrame, text: str = "text", key: str = "id", **options) -> DataFrame:
    """Every classified name of each text."""
    return classify_names(score_names(texts, text, key, **options))


def detect_corpus_names(
    texts: DataFrame, text: str = "text", caps: dict[str, int] | None = None, minimum: int = MIN_FREQUENCY, **options
) -> DataFrame:
    """Names classified over all texts together.

    Each text is scored in its row for the names it holds; evidence and frequencies are
    then summed per name, combined before the shuffle, so a name that stands once in
    each of many texts is found. ``caps`` (``CAPS`` for a report) keeps so many of the
    best names per type; by default all are returned.
    """
    hits = _name_hits(texts.withColumn("_key", F.lit(0)), text, "_key", minimum=1, **options)
    summed = (
        hits.groupBy("name")
        .agg(
            F.sum("frequency").alias("frequency"),
            F.array(*[F.sum(F.get("hits", F.lit(i))) for i in range(len(SIGNALS))]).alias("hits"),
            F.sum("pronouns").alias("pronouns"),
        )
        .where(F.col("frequency") >= minimum)
    )
    found = classify_names(_weighed(summed))
    if caps is None:
        return found
    measure = F.when(F.col("type") == "uncertain", F.col("frequency").cast("double")).otherwise(F.col("confidence"))
    best = [found.where(F.col("type") == kind).orderBy(F.desc(measure), F.desc("frequency"), "name").limit(n) for kind, n in caps.items()]
    return reduce(DataFrame.unionByName, best)


def people_and_projects(found: DataFrame) -> DataFrame:
    """Distinct ``name`` values of everything classified as a person or a project."""
    kind = F.col("type")
    return found.where(kind == "person").select("name").unionByName(found.where(kind == "project").select("name")).distinct()


def detection_score(path: Column) -> Column:
    """How promising a project-relative path is for name detection."""
    parts = F.filter(F.split(F.lower(path), "/", -1), lambda part: F.trim(part) != "")
    name = F.lower(stem(path))

    def either(*words: str) -> Column:
        return F.arrays_overlap(parts, string_array(words))

    def holds(*words: str) -> Column:
        hit = F.contains(name, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(name, F.lit(word))
        return hit

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    # Fixed weights.
    return (
        F.size(parts) * -5
        + points(F.size(parts) == 1, 100)
        + points(name == "readme", 90)
        + points(holds("migration"), 75)
        + points(holds("tool", "install"), 60)
        + points(holds("roadmap", "architecture"), 45)
        + points(either("notes"), 40)
        + points(either(".github"), -150)
        + points(either("compatibility", "validation"), -120)
        + points(either(".dotnet", ".nuget", "obj", "bin"), -120)
        + points(either("benchmarks", "examples"), -80)
        + points(either("fixtures"), -10)
    )


def files_for_detection(paths: DataFrame, max_files: int = 10, prioritize: bool = False) -> DataFrame:
    """Files to read for names: prose files if there are three, else prose first, then other readable ones."""
    suffix = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    kind = F.when(suffix.isin(lex.PROSE_SUFFIXES), 0).when(suffix.isin(lex.READABLE_SUFFIXES), 1)
    typed = paths.select("path", kind.alias("kind")).where(F.col("kind").isNotNull())
    enough = typed.agg(F.count_if(F.col("kind") == 0) >= 3).scalar()
    usable = typed.where((F.col("kind") == 0) | ~enough).withColumn("score", detection_score(F.col("path")))
    order = [F.desc("score"), F.lower("path")] if prioritize else [F.asc("kind"), F.asc("path")]
    return usable.orderBy(*order).limit(max_files).select("path", "score")
