"""Spelling correction of the user's side of a transcript."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.functions.text import WHITESPACE, let, lines_of, string_array, trim_start

# The corrections, the punctuation kept at a token's end and the
# patterns of tokens that are never touched.
CORRECTIONS = {
    "lsresdy": "already",
    "knoe": "know",
    "kno": "know",
    "befor": "before",
    "befroe": "before",
    "meny": "many",
    "diferent": "different",
    "tesing": "testing",
    "pleese": "please",
    "chekc": "check",
    "realy": "really",
    "writte": "write",
    "alredy": "already",
    "cant": "can't",
    "fine-tunned": "fine-tuned",
    "coherentlyy": "coherently",
}
END_PUNCTUATION = ".,!?;:'\")"
UNTOUCHED = [
    r"(?U)\d",
    r"[A-Z][a-z]+[A-Z]",
    r"^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$",
    r"[-_]",
    r"(?i)https?://|www\.|/Users/|~/|\.[a-z]{2,4}$",
    r"[`*_#{}\[\]\\]",
    r"^\p{Lu}",
]
MIN_TOKEN = 4


def _corrected(token: Column, known_names: Column, corrections: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(item) for pair in corrections.items() for item in pair])

    def fix(word: Column) -> Column:
        replacement = F.try_element_at(table, F.lower(word))
        eligible = replacement.isNotNull() & (F.length(word) >= MIN_TOKEN)
        for pattern in UNTOUCHED:
            eligible = eligible & ~word.rlike(pattern)
        eligible = eligible & ~F.array_contains(known_names, F.lower(word))
        return F.when(eligible, F.concat(replacement, F.substr(token, F.length(word) + 1))).otherwise(token)

    return let(F.rtrim(token, F.lit(END_PUNCTUATION)), fix)


def correct_text(
    text: Column, known_names: Iterable[str] = (), corrections: dict[str, str] | None = None
) -> Column:
    """Correct every white-space delimited token; the spacing stays as it is."""
    names = string_array(name.lower() for name in known_names)
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\s+|\S+"), F.lit(0))
    fixed = F.transform(pieces, lambda piece: _corrected(piece, names, corrections or CORRECTIONS))
    return F.array_join(fixed, "")


def correct_line(line: Column, known_names: Iterable[str] = (), corrections: dict[str, str] | None = None) -> Column:
    """Correct a ``>`` line after its marker; other lines pass unchanged."""
    head = F.regexp_extract(line, r"(?U)^\s*> ?", 0)

    def fix(prefix: Column) -> Column:
        message = F.substr(line, F.length(prefix) + 1)
        blank = F.ltrim(message, F.lit(WHITESPACE)) == ""
        return F.when((prefix == "") | blank, line).otherwise(
            F.concat(prefix, correct_text(message, known_names, corrections))
        )

    return let(head, fix)


def correct_transcript(
    content: Column, known_names: Iterable[str] = (), corrections: dict[str, str] | None = None
) -> Column:
    return F.array_join(F.transform(lines_of(content), lambda line: correct_line(line, known_names, corrections)), "\n")


def quote_lines(content: Column) -> Column:
    """How many lines start with ``>``."""
    return F.size(F.filter(lines_of(content), lambda line: F.startswith(trim_start(line), F.lit(">"))))
