"""Registry of people, projects and researched words, as tables.

``people``: ``(ord, name, aliases, source, contexts, relationship, confidence, canonical)``;
``projects``: ``(ord, name)``; ``research``: ``(word, type, confidence, confirmed)``;
``ambiguous``: ``(word)`` in lower case.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import lexicons as lex
from cairnlake.functions.partitions import broadcast_few, explode_rows, keep_wide
from cairnlake.functions.text import flat_text, half_even, is_blank, let, spellings
from cairnlake.session import cut_lineage


def seed_people(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """People of the first set-up; every alias becomes a row of its own that points to its person.

    ``people`` is ``(ord, name, relationship, context)`` and ``aliases`` ``(alias, name)``.
    """
    known = aliases.groupBy(F.lower("name").alias("_key")).agg(F.min("alias").alias("alias"))
    named = people.where(~is_blank(F.col("name"))).withColumn("_key", F.lower("name")).join(known, "_key", "left")
    common = ["ord", F.lit("onboarding").alias("source"), F.array("context").alias("contexts"), "relationship", F.lit(1.0).alias("confidence")]
    primary = named.select(
        F.col("name"),
        F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.lit(None).cast("string").alias("canonical"),
        *common,
    )
    pointing = named.where(F.col("alias").isNotNull()).select(
        F.col("alias").alias("name"), F.array("name").alias("aliases"), F.col("name").alias("canonical"), *common
    )
    return primary.unionByName(pointing)


def ambiguous_words(people: DataFrame, common_words: Iterable[str] = lex.COMMON_WORDS) -> DataFrame:
    """Registered names that are also everyday words."""
    return people.select(F.lower("name").alias("word")).where(F.col("word").isin(list(common_words))).distinct()


def context_scores(word: Column, context: Column, flat: Column) -> tuple[Column, Column]:
    """How many person and how many concept patterns fit the word; all arguments in lower case.

    ``flat`` is the context with runs of white space as one blank. A pattern is compiled and
    run only where ``flat`` holds one of its plain spellings around the word, which is a
    search of bytes; most of the patterns fit nowhere in a text.
    """
    quoted = F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    shown = flat_text(word)

    def fits(template: str) -> Column:
        run = F.rlike(context, F.concat(F.lit("(?Umd)"), F.replace(F.lit(template), F.lit("{name}"), quoted)))
        sides = [spellings(side) for side in template.split("{name}")]
        if len(sides) != 2 or None in sides:
            return run
        # A spelling that holds another one asks for nothing more.
        heads = [h for h in sides[0] if not any(h != o and h.endswith(o) for o in sides[0])]
        tails = [t for t in sides[1] if not any(t != o and t.startswith(o) for o in sides[1])]
        near = [F.contains(flat, F.concat(F.lit(head), shown, F.lit(tail))) for head in heads for tail in tails]
        return F.when(reduce(lambda a, b: a | b, near), run).otherwise(F.lit(False))

    def hits(templates: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [fits(template).cast("int") for template in templates])

    return hits(lex.PERSON_CONTEXTS), hits(lex.CONCEPT_CONTEXTS)


def disambiguate(word: Column, context: Column, flat: Column | None = None) -> Column:
    """``struct<type, confidence>`` decided by the context, NULL on a tie.

    With ``flat``, the ``flat_text`` of the lower-cased context, ``context`` is in lower case too.
    """

    def score(lowered: Column, flat: Column) -> Column:
        def judge(name: Column) -> Column:
            person, concept = context_scores(name, lowered, flat)
            return F.struct(person.alias("person"), concept.alias("concept"))

        return let(F.lower(word), judge)

    def verdict(kind: str, hits: Column, most: float) -> Column:
        sure = half_even(F.least(F.lit(most), 0.7 + hits * 0.1), 6)
        return F.struct(F.lit(kind).alias("type"), sure.alias("confidence"))

    def decide(found: Column) -> Column:
        person, concept = found["person"], found["concept"]
        return F.when(person > concept, verdict("person", person, 0.95)).when(
            concept > person, verdict("concept", concept, 0.90)
        )

    if flat is not None:
        return let(score(context, flat), decide)
    return let(let(F.lower(context), lambda lowered: let(flat_text(lowered), lambda flat: score(lowered, flat))), decide)


def judged_names(asked: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(context_id, _key, _verdict)`` of the distinct lower-cased names asked about each ``(context_id, context)``.

    The names of a text travel as one row, so that its text is lower-cased and flattened once.
    """
    names = asked.groupBy("context_id").agg(F.collect_set("_key").alias("_keys"))
    shown = names.join(contexts, "context_id").select("context_id", "_keys", F.lower("context").alias("_text"))

    def judge(texts: Column) -> Column:
        verdict = lambda key: F.struct(key.alias("_key"), disambiguate(key, texts["text"], texts["flat"]).alias("_verdict"))
        return F.transform("_keys", verdict)

    texts = F.struct(F.col("_text").alias("text"), flat_text(F.col("_text")).alias("flat"))
    verdicts = explode_rows(shown, let(texts, judge), "_judged", "context_id")
    return verdicts.select("context_id", "_judged.*")


def lookup(
    words: DataFrame,
    people: DataFrame,
    projects: DataFrame,
    research: DataFrame,
    ambiguous: DataFrame,
    contexts: DataFrame | None = None,
    common_words: Iterable[str] = lex.COMMON_WORDS,
) -> DataFrame:
    """Type of every word: person, then project, then confirmed research, else unknown.

    ``words`` has ``word`` and, with ``contexts`` ``(context_id, context)``, a
    ``context_id``. An ambiguous person name is first judged by its context, and so is a
    researched person whose name is an everyday word. Only those few words are joined
    with their context, so the texts are not repeated for every word.
    """
    names = people.select(
        F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), F.lower))).alias("_key"),
        F.struct("ord", F.col("canonical").isNotNull().alias("alias"), "name", "confidence", "source").alias("_person"),
    ).groupBy("_key").agg(F.min("_person").alias("_person"))
    project_names = projects.groupBy(F.lower("name").alias("_key")).agg(F.min_by("name", "ord").alias("_project"))
    confirmed = (
        research.where("confirmed")
        .groupBy(F.lower("word").alias("_key"))
        .agg(F.min(F.struct("word", "type", "confidence")).alias("_research"))
    )
    flagged = ambiguous.select(F.col("word").alias("_key"), F.lit(True).alias("_flag")).distinct()
    # Few distinct words make many rows: each is resolved once and the result joined back.
    words = cut_lineage(words)
    distinct = words.select(F.lower("word").alias("_key")).distinct()
    is_person = F.col("_person").isNotNull()
    is_project = ~is_person & F.col("_project").isNotNull()
    is_research = ~is_person & F.col("_project").isNull() & F.col("_research").isNotNull()
    doubtful = (is_person & F.col("_flag").isNotNull()) | (
        is_research & (F.lower("_research.type") == "person") & F.col("_key").isin(list(common_words))
    )
    known = (
        distinct.join(names, "_key", "left")
        .join(project_names, "_key", "left")
        .join(confirmed, "_key", "left")
        .join(flagged, "_key", "left")
        .select(
            "_key",
            F.when(is_person, "person").when(is_project, "project").when(is_research, F.col("_research.type")).otherwise("unknown").alias("_type"),
            F.when(is_person, F.col("_person.confidence")).when(is_project, 1.0).when(is_research, F.col("_research.confidence")).otherwise(0.0).alias("_confidence"),
            F.when(is_person, F.col("_person.source")).when(is_project, "onboarding").when(is_research, "wiki").otherwise("none").alias("_source"),
            F.when(is_person, F.col("_person.name")).when(is_project, F.col("_project")).alias("_name"),
            doubtful.alias("_doubtful"),
        )
    )
    found = words.withColumn("_key", F.lower("word")).join(known, "_key")
    if contexts is None:
        judged = found.withColumn("_verdict", F.lit(None).cast("struct<type:string,confidence:double>"))
    else:
        verdicts = judged_names(found.where("_doubtful"), contexts.where(~is_blank(F.col("context"))))
        judged = found.join(verdicts, ["context_id", "_key"], "left")
    sure = F.col("_verdict").isNotNull()
    return judged.select(
        *words.columns,
        F.coalesce("_verdict.type", "_type").alias("type"),
        F.coalesce("_verdict.confidence", "_confidence").alias("confidence"),
        F.when(F.col("_verdict.type") == "concept", "context_disambiguated").otherwise(F.col("_source")).alias("source"),
        F.when(sure, F.col("word")).otherwise(F.coalesce("_name", "word")).alias("name"),
    )


def people_in_queries(queries: DataFrame, people: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """People whose name or alias occurs in ``(query_id, query)`` as whole words, in registry order.

    Names of one word are matched against the words of the query in an equi join of
    narrow rows; a longer name is matched by its first word and then verified in the
    text. Ambiguous names must be judged persons by the query itself. Only queries with
    something to verify or judge are joined with their text again.
    """
    first_word = r"(?U)\w++"
    spelled = people.select("ord", "name", F.explode(F.concat(F.array("name"), "aliases")).alias("spelling"))
    flagged = ambiguous.select(F.col("word").alias("_key"), F.lit(True).alias("_flag")).distinct()
    names = (
        spelled.withColumn("_key", F.lower("spelling"))
        .withColumn("_word", F.regexp_extract("_key", first_word, 0))
        .join(flagged, "_key", "left")
        .select("ord", "name", "_key", "_word", F.coalesce("_flag", F.lit(False)).alias("_flag"), (F.col("_key") != F.col("_word")).alias("_long"))
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(first_word), F.lit(0)))
    asked = explode_rows(queries, words, "_word", "query_id")
    # Most words are no names: they stay in their task where the names are few, and are made once.
    met = cut_lineage(asked.join(broadcast_few(names), "_word").drop("_word"))
    lowered = F.lower("query")
    whole = F.contains(lowered, F.col("_key")) & F.rlike(lowered, F.concat(F.lit(r"(?U)\b\Q"), F.col("_key"), F.lit(r"\E\b")))
    columns = ["query_id", "name", "ord", "_key", "_flag"]
    verified = keep_wide(met.where("_long"), "query_id").join(queries, "query_id").where(whole).select(columns)
    found = met.where(~F.col("_long")).select(columns).unionByName(verified)
    contexts = queries.select(F.col("query_id").alias("context_id"), F.col("query").alias("context"))
    persons = judged_names(found.where("_flag").withColumnRenamed("query_id", "context_id"), contexts).where("_verdict.type = 'person'")
    sure = found.where("_flag").join(persons.select(F.col("context_id").alias("query_id"), "_key"), ["query_id", "_key"])
    columns = ["query_id", "name", "ord"]
    return (
        found.where(~F.col("_flag")).select(columns).unionByName(sure.select(columns))
        .groupBy("query_id", "name")
        .agg(F.min("ord").alias("ord"))
    )


def unknown_words(
    queries: DataFrame,
    people: DataFrame,
    projects: DataFrame,
    research: DataFrame,
    common_words: Iterable[str] = lex.COMMON_WORDS,
) -> DataFrame:
    """Distinct capitalised words of ``(query_id, query)`` that no table knows."""
    capitalized = F.array_distinct(F.regexp_extract_all("query", F.lit(r"(?U)\b[A-Z][a-z]{2,15}\b"), F.lit(0)))
    words = explode_rows(queries, capitalized, "word", "query_id").where(~F.lower("word").isin(list(common_words)))
    known = (
        people.select(F.explode(F.concat(F.array("name"), "aliases")).alias("name"))
        .unionByName(projects.select("name"))
        .unionByName(research.where("confirmed").select(F.col("word").alias("name")))
        .select(F.lower("name").alias("_key"))
        .distinct()
    )
    return words.withColumn("_key", F.lower("word")).join(known, "_key", "left_anti").drop("_key")


def learn_people(detected: DataFrame, people: DataFrame, projects: DataFrame, min_confidence: float = 0.75) -> DataFrame:
    """Detected persons sure enough and not yet registered."""
    sure = detected.where((F.col("type") == "person") & (F.col("confidence") >= min_confidence))
    new = sure.join(people.select("name"), "name", "left_anti").withColumn("_key", F.lower("name"))
    return new.join(projects.select(F.lower("name").alias("_key")), "_key", "left_anti").drop("_key")


def classify_payload(
    word: Column, status: Column, page_type: Column, title: Column, extract: Column, description: Column
) -> Column:
    """What an encyclopedia page says about a word: ``struct<type, confidence, summary, title, note>``.

    Confidences are fixed values: an unknown page hints at an unusual name.
    """
    text = F.lower(F.coalesce(extract, F.lit("")))
    lowered = F.lower(word)
    name_page = reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in lex.NAME_PHRASES])
    place_page = reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in lex.PLACE_PHRASES])
    direct = F.contains(text, F.concat(lowered, F.lit(" is a"))) | F.contains(text, F.concat(lowered, F.lit(" (name")))
    listed = F.contains(F.lower(F.coalesce(description, F.lit(""))), F.lit("name"))
    missing = status == 404
    failed = (status < 200) | (status >= 300)
    several = F.lower(F.coalesce(page_type, F.lit(""))) == "disambiguation"
    found = ~missing & ~failed
    return F.struct(
        F.when(missing, "person")
        .when(failed, "unknown")
        .when(several, F.when(listed, "person").otherwise("ambiguous"))
        .when(name_page, "person")
        .when(place_page, "place")
        .otherwise("concept")
        .alias("type"),
        F.when(missing, 0.70)
        .when(failed, 0.0)
        .when(several, F.when(listed, 0.65).otherwise(0.40))
        .when(name_page, F.when(direct, 0.90).otherwise(0.80))
        .when(place_page, 0.80)
        .otherwise(0.60)
        .alias("confidence"),
        F.when(found & ~is_blank(text), F.substring(text, 1, 200)).alias("summary"),
        F.when(found, F.when(is_blank(F.coalesce(title, F.lit(""))), word).otherwise(title)).alias("title"),
        F.when(missing, "not found - likely a proper noun or unusual name")
        .when(found & several & listed, "disambiguation page with name entries")
        .alias("note"),
    )


def confirm_research(research: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Research rows after confirmations ``(word, type)``; an unseen word is added with a default confidence."""
    asked = confirmations.select(F.lower("word").alias("_key"), F.col("word").alias("_word"), F.col("type").alias("_type"))
    default = F.when(F.lower("_type") == "person", 0.90).otherwise(0.80)
    return (
        research.withColumn("_key", F.lower("word"))
        .join(asked, "_key", "full")
        .select(
            F.coalesce("word", "_word").alias("word"),
            F.coalesce("_type", "type").alias("type"),
            F.coalesce("confidence", default).alias("confidence"),
            (F.coalesce("confirmed", F.lit(False)) | F.col("_type").isNotNull()).alias("confirmed"),
        )
    )


def confirmed_people(research: DataFrame) -> DataFrame:
    """Registry rows for confirmed persons, at least 0.90 sure."""
    return research.where(F.col("confirmed") & (F.lower("type") == "person")).select(
        F.col("word").alias("name"), F.lit("wiki").alias("source"), F.greatest(F.lit(0.90), "confidence").alias("confidence")
    )


PREVIEW = 8


def summary(
    people: DataFrame, projects: DataFrame, ambiguous: DataFrame, research: DataFrame, preview_rows: int = PREVIEW
) -> DataFrame:
    """Counts with a preview of the first ``preview_rows`` people."""
    first = people.orderBy("ord", F.col("canonical").isNotNull(), "name").limit(preview_rows)
    preview = first.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("canonical").isNotNull().alias("alias"), "name"))), lambda p: p["name"]),
            ", ",
        )
    ).scalar()
    return people.agg(F.count("*").alias("people")).select(
        "people",
        preview.alias("preview"),
        projects.agg(F.count("*")).scalar().alias("projects"),
        ambiguous.agg(F.count("*")).scalar().alias("ambiguous"),
        research.agg(F.count("*")).scalar().alias("researched"),
    )
