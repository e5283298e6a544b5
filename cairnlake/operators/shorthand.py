"""Compressed one-line notation of a drawer: entities, topics, key sentence, signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import lexicons as lex
from cairnlake.functions.text import estimated_tokens, half_even, is_blank, let, stem, trim

# Short description of the notation for readers of compressed text.
NOTATION = (
    "header: wing|room|date|source; entry: 0:CODES|topics|\"key sentence\"|emotions|FLAGS. "
    "CODES are upper-case entity codes joined by +, topics are joined by _, ??? and misc stand for none."
)


def entity_codes(
    text: Column, entities: dict[str, str] | None = None, skipped: tuple[str, ...] = ()
) -> Column:
    """Codes of configured names in the text, else of up to three capitalised words.

    Configured names need a capital letter and must not contain a skipped name. A word
    qualifies when it is not the first, has only its first letter in upper case once
    other characters are removed, and is not a stopword.
    """
    words = F.split(trim(text), r"(?U)\s+", -1)
    clean = F.transform(words, lambda word, i: F.when(i > 0, F.regexp_replace(word, "[^a-zA-Z]", "")))
    names = F.filter(
        clean,
        lambda word: word.isNotNull() & word.rlike("^[A-Z][a-z]+$") & ~F.lower(word).isin(lex.SHORTHAND_STOPWORDS),
    )
    guessed = F.slice(F.array_distinct(F.transform(names, lambda word: F.upper(F.substring(word, 1, 3)))), 1, 3)
    configured = [
        (name, code)
        for name, code in (entities or {}).items()
        if name.strip() and code.strip() and any(c.isupper() for c in name)
        and not any(part.lower() in name.lower() for part in skipped)
    ]
    if not configured:
        return guessed
    lowered = F.lower(text)
    present = F.array(*[F.when(F.contains(lowered, F.lit(name.lower())), F.lit(code)) for name, code in configured])
    return let(
        F.array_distinct(F.filter(present, lambda code: code.isNotNull())),
        lambda found: F.when(F.size(found) > 0, found).otherwise(guessed),
    )


def topics(text: Column, stopwords: list[str] = lex.SHORTHAND_STOPWORDS, limit: int = 3) -> Column:
    """Heaviest words: one point per use, two more per capitalised use and per joined or camel-case use."""
    weighted = F.transform(
        F.regexp_extract_all(text, F.lit("[a-zA-Z][a-zA-Z_-]{2,}"), F.lit(0)),
        lambda word: F.struct(
            F.lower(word).alias("word"),
            (
                F.lit(1)
                + F.when(word.rlike("^[A-Z]"), 2).otherwise(0)
                + F.when(word.rlike("[_-]|^.+[A-Z]"), 2).otherwise(0)
            ).alias("weight"),
        ),
    )
    useful = F.sort_array(F.filter(weighted, lambda w: ~w["word"].isin(stopwords)))

    def rank(ordered: Column) -> Column:
        # Equal words are adjacent, so a word's weight is the sum over one run.
        starts = F.filter(
            F.transform(
                ordered, lambda w, i: F.when((i == 0) | (w["word"] != F.get(ordered, i - 1)["word"]), i)
            ),
            lambda i: i.isNotNull(),
        )

        def total(at: Column, i: Column, all_starts: Column) -> Column:
            run = F.slice(ordered, at + 1, F.coalesce(F.get(all_starts, i + 1), F.size(ordered)) - at)
            weight = F.aggregate(run, F.lit(0), lambda acc, w: acc + w["weight"])
            return F.struct((-weight).alias("order"), F.get(ordered, at)["word"].alias("word"))

        return let(starts, lambda s: F.transform(s, lambda at, i: total(at, i, s)))

    return F.transform(F.slice(F.sort_array(let(useful, rank)), 1, limit), lambda w: w["word"])


def signals(text: Column, table: dict[str, str]) -> Column:
    """First three distinct codes whose key occurs in the text, in table order."""
    lowered = F.lower(text)

    def find(low: Column) -> Column:
        hits = F.array(*[F.when(F.contains(low, F.lit(key)), F.lit(code)) for key, code in table.items()])
        return F.slice(F.array_distinct(F.filter(hits, lambda code: code.isNotNull())), 1, 3)

    return let(lowered, find)


def key_sentence(text: Column, words: list[str] = lex.DECISION_WORDS) -> Column:
    """Sentence with the most decision words; short ones are favoured, ties go to the shorter, then the earlier."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?\n]+", -1), trim), lambda s: F.length(s) > 10)

    def weigh(sentence: Column, i: Column) -> Column:
        lowered = F.lower(sentence)
        size = F.length(sentence)
        hits = reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(word)).cast("int") for word in words])
        score = (
            hits * 2
            + F.when(size < 80, 1).otherwise(0)
            + F.when(size < 40, 1).otherwise(0)
            - F.when(size > 150, 2).otherwise(0)
        )
        return F.struct((-score).alias("order"), size.alias("size"), i.alias("i"), sentence.alias("sentence"))

    def shorten(best: Column) -> Column:
        return F.when(F.length(best) > 55, F.concat(F.substring(best, 1, 52), F.lit("..."))).otherwise(best)

    best = F.array_min(F.transform(sentences, weigh))["sentence"]
    return let(F.coalesce(best, F.lit("")), shorten)


def compress_text(
    text: Column, header: Column | None = None, entities: dict[str, str] | None = None, skipped: tuple[str, ...] = ()
) -> Column:
    """The whole notation of one text, below an optional header line."""

    def joined(values: Column, mark: str, default: str | None) -> Column:
        return let(values, lambda v: F.when(F.size(v) > 0, F.array_join(F.slice(v, 1, 3), mark)).otherwise(F.lit(default)))

    sentence = let(
        key_sentence(text),
        lambda s: F.when(s != "", F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit("'")), F.lit('"'))),
    )
    entry = F.concat_ws(
        "|",
        F.concat(F.lit("0:"), joined(entity_codes(text, entities, skipped), "+", "???")),
        joined(topics(text), "_", "misc"),
        sentence,
        joined(signals(text, lex.EMOTION_SIGNALS), "+", None),
        joined(signals(text, lex.FLAG_SIGNALS), "+", None),
    )
    return entry if header is None else F.concat_ws("\n", header, entry)


def header_line(wing: Column, room: Column, date: Column, source_file: Column) -> Column:
    """``wing|room|date|source`` with ``?`` for blanks; NULL when wing and source are both blank."""

    def shown(value: Column) -> Column:
        return F.when(is_blank(value), "?").otherwise(value)

    plain = [F.when(F.coalesce(c, F.lit("")) == "", "?").otherwise(c) for c in (wing, room)]
    source = F.when(is_blank(source_file), "?").otherwise(stem(source_file))
    return F.when(~(is_blank(source_file) & is_blank(wing)), F.concat_ws("|", *plain, shown(date), source))


def compress(
    drawers: DataFrame, wing: str | None = None, entities: dict[str, str] | None = None, skipped: tuple[str, ...] = ()
) -> DataFrame:
    """Compressed text and size figures of every drawer."""
    scope = drawers if wing is None else drawers.where(F.col("wing") == wing)
    header = header_line(F.col("wing"), F.col("room"), F.col("date"), F.col("source_file"))
    compressed = scope.select(
        "id", "wing", "room", "source_file", "text", compress_text(F.col("text"), header, entities, skipped).alias("compressed")
    )
    measured = compressed.select(
        "id",
        "wing",
        "room",
        "source_file",
        "compressed",
        estimated_tokens(F.col("text")).alias("original_tokens"),
        estimated_tokens(F.col("compressed")).alias("compressed_tokens"),
        F.length("text").alias("original_chars"),
        F.length("compressed").alias("compressed_chars"),
    )
    ratio = half_even(F.col("original_tokens") / F.greatest(F.col("compressed_tokens"), F.lit(1)).cast("double"), 1)
    return measured.withColumn("ratio", ratio)


def compression_totals(compressed: DataFrame) -> DataFrame:
    names = ["original_chars", "compressed_chars", "original_tokens", "compressed_tokens"]
    return compressed.agg(
        F.count("*").alias("drawers"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names]
    )


def assign_codes(names: list[str]) -> dict[str, str]:
    """Three-letter upper-case code per set-up name; a taken code is widened, then numbered."""
    codes: dict[str, str] = {}
    for name in (raw.strip() for raw in names):
        if not name or name in codes:
            continue
        taken = set(codes.values())
        # Three letters, then longer beginnings; the whole of a long name is not tried.
        widest = max(len(name) - 1, min(len(name), 4))
        options = [name[:width].upper() for width in (3, *range(min(len(name), 4), widest + 1))]
        free = [code for code in options if code not in taken]
        codes[name] = free[0] if free else f"{options[-1]}{len(codes) + 1}"
    return codes
