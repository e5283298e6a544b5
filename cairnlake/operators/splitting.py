"""Split files that hold several sessions, and name the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import lexicons as lex
from cairnlake.functions.arrays import groups_from, positions
from cairnlake.functions.partitions import posexplode_rows
from cairnlake.functions.text import let, lines_of, stem, string_array, trim

# Fixed rules.
LOOKAHEAD = 6
MIN_LINES = 10
MIN_SESSIONS = 2


def session_starts(lines: Column, mark: str = lex.SESSION_MARK, resumed: list[str] = lex.RESUME_MARKS) -> Column:
    """Zero-based lines that open a session: they hold ``mark`` and no resume sign follows closely."""
    marked = positions(lines, lambda line: F.contains(line, F.lit(mark)))

    def opens(at: Column) -> Column:
        nearby = F.lower(F.array_join(F.slice(lines, at + 1, LOOKAHEAD), ""))
        fresh = F.lit(True)
        for sign in resumed:
            fresh = fresh & ~F.contains(nearby, F.lit(sign.lower()))
        return fresh

    return F.filter(marked, opens)


def _first_match(lines: Column, pattern: str, group: int) -> Column:
    return F.get(
        F.filter(F.transform(lines, lambda line: F.regexp_extract(line, pattern, group)), lambda hit: hit != ""), F.lit(0)
    )


def _head(lines: Column, count: int | None) -> Column:
    return lines if count is None else F.slice(lines, 1, count)


def session_time(lines: Column, head_lines: int | None = None) -> Column:
    """``yyyy-mm-dd_hmmAM`` of the first clock line, NULL when there is none; ``head_lines`` looks at the first ones only."""
    # Fixed value: how a clock line looks.
    pattern = r"(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"

    def render(hit: Column) -> Column:
        def part(group: int) -> Column:
            return F.regexp_extract(hit, pattern, group)

        month = F.array_position(string_array(lex.MONTHS), F.lower(part(2))).cast("string")
        clock = F.regexp_replace(part(1), "[: ]", "")
        return F.when(
            hit.isNotNull(),
            F.concat(part(4), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0"), F.lit("_"), clock),
        )

    return let(_first_match(_head(lines, head_lines), pattern, 0), render)


def session_people(
    lines: Column,
    people: list[str] = lex.KNOWN_PEOPLE,
    usernames: dict[str, str] | None = None,
    head_lines: int | None = None,
) -> Column:
    """Known people named in the lines, or the first ``head_lines`` of them, plus the owner of the first home path, sorted."""

    def find(text: Column) -> Column:
        named = [
            F.when(text.rlike(r"(?iU)\b\Q" + person + r"\E\b"), F.lit(person)) for person in people
        ]
        owner = F.lower(F.regexp_extract(text, r"(?i)[\\/](?:Users|home)[\\/](\w+)[\\/]", 1))
        for user, person in (usernames or {}).items():
            named.append(F.when(owner == user.lower(), F.lit(person)))
        present = F.filter(F.array(*named), lambda name: name.isNotNull())
        return F.array_sort(F.array_distinct(present))

    if not people and not usernames:
        return F.array().cast("array<string>")
    return let(F.array_join(_head(lines, head_lines), "\n"), find)


def session_subject(lines: Column) -> Column:
    """Slug of the first real prompt, at most sixty characters, else ``session``."""
    prompts = F.transform(
        F.filter(lines, lambda line: F.startswith(line, F.lit("> "))), lambda line: trim(F.substr(line, F.lit(3)))
    )
    real = F.filter(prompts, lambda p: (F.length(p) > 5) & ~p.rlike(lex.SHELL_PROMPTS))
    cleaned = F.regexp_replace(trim(F.regexp_replace(F.get(real, F.lit(0)), r"(?U)[^\w\s-]", "")), r"(?U)\s+", "-")
    return F.coalesce(F.substring(cleaned, 1, 60), F.lit("session"))


def session_file_name(path: Column, number: Column, lines: Column, people: Column) -> Column:
    base = F.substring(F.regexp_replace(stem(path), r"(?U)[^\w-]", "_"), 1, 40)
    when = F.coalesce(session_time(lines), F.concat(F.lit("part"), F.lpad(number.cast("string"), 2, "0")))
    who = F.when(F.size(people) > 0, F.array_join(F.slice(people, 1, 3), "-")).otherwise("unknown")
    name = F.concat(base, F.lit("__"), when, F.lit("_"), who, F.lit("_"), session_subject(lines), F.lit(".txt"))
    return F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\.-]", "_"), "_+", "_")


def split_sessions(
    files: DataFrame,
    mark: str = lex.SESSION_MARK,
    min_sessions: int = MIN_SESSIONS,
    min_lines: int = MIN_LINES,
    people: list[str] = lex.KNOWN_PEOPLE,
    usernames: dict[str, str] | None = None,
) -> DataFrame:
    """Sessions of every ``(path, content)`` file with enough of them.

    Returns ``(path, sessions_found, number, line_count, file_name, content)``; a short
    session keeps its number but is not returned. Lines before the first are dropped.
    """
    # A trailing line break ends the last line, it does not open another.
    lines = lines_of(F.regexp_replace("content", r"\r?\n\z", ""))
    cut = files.select("path", F.transform(lines, lambda line: F.rtrim(line, F.lit("\r"))).alias("lines"))
    found = cut.withColumn("starts", session_starts(F.col("lines"), mark))
    parts = F.when(F.size("starts") >= min_sessions, groups_from(F.col("lines"), F.col("starts")))
    opened = F.size("starts").alias("sessions_found")
    sessions = posexplode_rows(found, parts, "i", "part", "path", opened).where(F.size("part") >= min_lines)
    named = sessions.withColumn("people", session_people(F.col("part"), people, usernames))
    return named.select(
        "path",
        "sessions_found",
        (F.col("i") + 1).alias("number"),
        F.size("part").alias("line_count"),
        session_file_name(F.col("path"), F.col("i") + 1, F.col("part"), F.col("people")).alias("file_name"),
        F.array_join("part", "\n").alias("content"),
    )
