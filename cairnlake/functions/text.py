"""Text column builders: tokens, trimming, names, identifiers, rounding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters that take part in a word boundary; a token itself is ASCII only.
WORD_CLASS = r"\p{L}\p{Mn}\p{Nd}\p{Pc}\x{200C}\x{200D}"
TOKEN_PATTERN = rf"(?<![{WORD_CLASS}])[a-z0-9_]++(?![{WORD_CLASS}])"

# All characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (a lambda variable, never re-evaluated)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased ASCII word tokens in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def trim(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (trim(text) == "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def half_even(value: Column, places: int) -> Column:
    """Round half to even at ``places`` decimals (Spark ``round`` is half up)."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def ellipsis(text: Column, limit: int, keep: int) -> Column:
    """Text longer than ``limit`` is cut to ``keep`` characters and gets three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.replace(trim(text), F.lit("\n"), F.lit(" "))


def slug(text: Column) -> Column:
    """Lower-case identifier of ``[a-z0-9._-]``; empty when nothing usable remains."""
    value = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    value = F.lower(trim(value))
    value = F.regexp_replace(value, r"(?U)[\s/\\]+", "_")
    value = F.regexp_replace(value, r"[^a-z0-9._-]+", "_")
    value = F.regexp_replace(value, r"([_-])\1+", "$1")
    return F.btrim(value, F.lit("_-."))


def display_name(text: Column) -> Column:
    """Control characters removed, white space runs collapsed to one blank."""
    value = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(trim(value), r"(?U)\s+", " ")


def clean_content(text: Column) -> Column:
    """Line endings normalised to ``\\n`` and control characters removed."""
    value = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return trim(F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def iso_date(text: Column) -> Column:
    """The text itself when it is a strict ``yyyy-MM-dd`` date, else NULL."""
    parsed = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(parsed, "yyyy-MM-dd") == text, text)


def wing_name(name: Column) -> Column:
    return F.translate(F.lower(name), " -", "__")


def agent_wing(agent: Column) -> Column:
    return F.concat(F.lit("wing_"), F.translate(F.lower(agent), " ", "_"))


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def predicate_id(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def _short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 24)


def mined_id(wing: Column, room: Column, source_file: Column, chunk_index: Column) -> Column:
    digest = _short_hash(F.concat(source_file, chunk_index.cast("string")))
    return F.concat_ws("_", F.lit("drawer"), wing, room, digest)


def content_id(wing: Column, room: Column, source_file: Column, content: Column) -> Column:
    digest = _short_hash(F.concat_ws("\n", wing, room, source_file, content))
    return F.concat_ws("_", F.lit("drawer"), wing, room, digest)


def diary_id(wing: Column, topic: Column, entry: Column) -> Column:
    return F.concat_ws("_", F.lit("diary"), wing, topic, _short_hash(F.concat_ws("\n", wing, topic, entry)))


def estimated_tokens(text: Column) -> Column:
    """Word count times 1.3, truncated, at least one."""
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    return F.greatest(F.lit(1), F.floor(words * 1.3).cast("int"))


def lines_of(text: Column) -> Column:
    """Split on ``\\n``, keeping empty lines."""
    return F.split(text, "\n", -1)


_META, _CLASSES = "|(){}[]*+?.^$\\", "bBdDwWsS"


def _closing(pattern: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``, -1 if there is none."""
    depth, n, opening = 0, at, pattern[at]
    closing = {"(": ")", "[": "]", "{": "}"}[opening]
    while n < len(pattern):
        if pattern[n] == "\\":
            n += 1
        elif opening == "(" and pattern[n] == "[":
            n = _closing(pattern, n)
            if n < 0:
                return -1
        elif pattern[n] == opening:
            depth += 1
        elif pattern[n] == closing:
            depth -= 1
            if depth == 0:
                return n
        n += 1
    return -1


def required_literals(pattern: str) -> list[list[str]]:
    """What every match of a pattern holds: of each list at least one of its texts.

    Only plain runs and groups are looked at; a pattern with anything else (flags, look
    around, other escapes) gives an empty list, that is, no demand.
    """
    options: list[list[list[str]]] = [[]]
    run, n = "", 0
    while n <= len(pattern):
        char = pattern[n] if n < len(pattern) else ""
        literal, group = "", None
        if char == "\\":
            char = pattern[n + 1 : n + 2]
            if char.isalnum() and char not in _CLASSES:
                return []
            literal = "" if char.isalnum() else char
            n += 2
        elif char in ("(", "["):
            end = _closing(pattern, n)
            body = pattern[n + 1 : end]
            if end < 0 or (char == "[" and ("[" in body or body in ("", "^"))) or (char == "(" and body.startswith("?") and not body.startswith("?:")):
                return []
            if char == "(":
                group = required_literals(body.removeprefix("?:"))
                if not group and ("(?" in body or "\\" in body):
                    return []
            n = end + 1
        else:
            literal = char if char not in _META else ""
            n += 1
        after = pattern[n : n + 1]
        optional = after != "" and after in "?*{"
        if after == "{":
            end = _closing(pattern, n)
            if end < 0:
                return []
            n = end + 1
        while n < len(pattern) and pattern[n] in "?*+":
            n += 1
        if literal and not optional:
            run += literal
        if run and (not literal or optional or after == "+"):
            options[-1].append([run])
            run = ""
        if group and not optional:
            options[-1].extend(group)
        if char == "|" and not literal and pattern[n - 1] == "|":
            options.append([])
        if char == "":
            break
    if len(options) == 1:
        return sorted(options[0], key=lambda texts: -min(map(len, texts)))
    best = [max(option, key=lambda texts: min(map(len, texts)), default=[]) for option in options]
    return [[text for texts in best for text in texts]] if all(best) else []


def may_match(text: Column, pattern: str) -> Column:
    """False where a text lacks what every match of the pattern holds; a plain search of bytes, far cheaper than the pattern."""
    wanted = [reduce(lambda a, b: a | b, [F.contains(text, F.lit(part)) for part in parts]) for parts in required_literals(pattern)]
    return reduce(lambda a, b: a & b, wanted) if wanted else F.lit(True)


_PIECE = re.compile(r"\\b|\^|(?P<blank>\\s\+)|\(\?:(?P<any>[^()]*)\)|\[(?P<set>[^\]^-]*)\]|(?P<char>[^\\\[\](){}*+?.$|^])")


def spellings(pattern: str) -> list[str] | None:
    """All texts that a simple pattern matches, with one blank for ``\\s+``; None where it is not that simple."""
    found, at = [""], 0
    while at < len(pattern):
        piece = _PIECE.match(pattern, at)
        if piece is None:
            return None
        at = piece.end()
        choices: list[str] | None = [piece["char"] or (" " if piece["blank"] else "")]
        if piece["any"] is not None:
            parts = [spellings(part) for part in piece["any"].split("|")]
            choices = None if None in parts else [text for part in parts for text in part]
        elif piece["set"] is not None:
            inside = piece["set"].replace("\\s", " ")
            choices = None if "\\" in inside else list(inside)
        if choices is None or pattern[at : at + 1] in ("*", "+", "{"):
            return None
        if pattern[at : at + 1] == "?":
            choices, at = [*choices, ""], at + 1
        found = [text + choice for text in found for choice in choices]
    return found


def flat_text(text: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(text, r"(?U)\s++", " ")


def string_array(values: Iterable[str]) -> Column:
    """Literal array; an empty one keeps the string type."""
    items = [F.lit(value) for value in values]
    return F.array(*items) if items else F.array().cast("array<string>")


def count_occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a plain substring."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (removed / F.length(needle)).cast("int")).otherwise(F.lit(0))
