"""Chat exports in several JSON shapes normalised to one plain transcript.

A file is one row. Every parser is a column that yields ``array<struct<role, text>>`` or
NULL, and the first one that yields a transcript wins, so normalisation needs no shuffle.
Node trees alone leave the JVM (``node_trees``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.ordered import next_value
from cairnlake.functions.partitions import keep_wide
from cairnlake.functions.text import is_blank, let, lines_of, trim
from cairnlake.operators.node_trees import branch_messages
from cairnlake.operators.spelling import correct_text, correct_transcript, quote_lines

MAX_FILE_BYTES = 500 * 1024 * 1024
TURN_BLOCK = 4096
MESSAGES = "array<struct<role:string,text:string>>"
# Fixed value: marks a message that only carries a command.
COMMAND_MARK = "<command-message>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _is_object(value: Column) -> Column:
    return F.startswith(_kind(value), F.lit("OBJECT"))


def _is_array(value: Column) -> Column:
    return F.startswith(_kind(value), F.lit("ARRAY"))


def _field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _string(value: Column, path: str = "$") -> Column:
    """The string at ``path``; NULL when it is missing or not a string."""
    found = _field(value, path)
    return F.when(_kind(found) == "STRING", F.try_variant_get(value, path, "string"))


def _items(value: Column) -> Column:
    return F.when(_is_array(value), F.try_variant_get(value, "$", "array<variant>"))


def content_text(content: Column) -> Column:
    """Text of a message body: a string, a list of text parts or one text object."""
    parts = F.transform(
        _items(content),
        lambda item: F.when(_kind(item) == "STRING", _string(item)).when(
            _string(item, "$.type") == "text", F.coalesce(_string(item, "$.text"), F.lit(""))
        ),
    )
    return (
        F.when(_kind(content) == "STRING", trim(_string(content)))
        .when(_is_array(content), trim(F.array_join(F.filter(parts, lambda part: part.isNotNull()), " ")))
        .when(_is_object(content), trim(F.coalesce(_string(content, "$.text"), F.lit(""))))
        .otherwise("")
    )


def _message(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _usable(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"].isNotNull() & ~is_blank(m["text"]))


def _at_least_two(messages: Column) -> Column:
    return F.when(F.size(messages) >= 2, messages)


def _json_lines(content: Column) -> Column:
    lines = F.filter(F.transform(lines_of(content), trim), lambda line: line != "")
    return F.filter(F.transform(lines, F.try_parse_json), _is_object)


def typed_lines_messages(entries: Column) -> Column:
    """JSON line objects ``{type: human|user|assistant, message: {content}}``."""

    def read(entry: Column) -> Column:
        kind = _string(entry, "$.type")
        role = F.when(kind.isin("human", "user"), "user").when(kind == "assistant", "assistant")
        return _message(role, content_text(_field(entry, "$.message.content")))

    return let(_usable(F.transform(entries, read)), _at_least_two)


def event_lines_messages(entries: Column) -> Column:
    """JSON line objects with a ``session_meta`` line and ``event_msg`` payloads."""

    def read(entry: Column) -> Column:
        kind = _string(entry, "$.payload.type")
        role = F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant")
        event = _string(entry, "$.type") == "event_msg"
        return _message(F.when(event, role), trim(F.coalesce(_string(entry, "$.payload.message"), F.lit(""))))

    opened = F.exists(entries, lambda e: F.coalesce(_string(e, "$.type") == "session_meta", F.lit(False)))
    return F.when(opened, let(_usable(F.transform(entries, read)), _at_least_two))


def role_list_messages(data: Column) -> Column:
    """A message list, or one wrapped in ``messages`` / ``chat_messages``, or a list of conversations."""

    def present(value: Column) -> Column:
        return F.when(~F.is_variant_null(value), value)

    def read(item: Column) -> Column:
        role = _string(item, "$.role")
        side = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai"), "assistant")
        return _message(side, content_text(_field(item, "$.content")))

    wrapped = F.coalesce(present(_field(data, "$.messages")), present(_field(data, "$.chat_messages")))
    root = _items(F.when(_is_object(data), wrapped).otherwise(data))

    def collect(items: Column) -> Column:
        nested = _is_array(_field(F.get(items, F.lit(0)), "$.chat_messages"))
        inner = F.flatten(
            F.filter(F.transform(items, lambda c: _items(_field(c, "$.chat_messages"))), lambda a: a.isNotNull())
        )
        return F.transform(F.when(nested, inner).otherwise(items), read)

    return let(_usable(let(root, collect)), _at_least_two)


def channel_messages(data: Column) -> Column:
    """A channel export ``[{type: message, user, text}]``.

    The first speaker is the user; a new speaker takes the role opposite to the message
    before it. Only first appearances decide, so the fold runs over the speakers.
    """

    def read(item: Column) -> Column:
        speaker = F.coalesce(_string(item, "$.user"), _string(item, "$.username"))
        said = trim(F.coalesce(_string(item, "$.text"), F.lit("")))
        return F.struct(F.when(_string(item, "$.type") == "message", speaker).alias("speaker"), said.alias("text"))

    said = F.filter(
        F.transform(_items(data), read), lambda m: ~is_blank(m["speaker"]) & ~is_blank(m["text"])
    )

    def roles_of(order: Column) -> Column:
        def add(roles: Column, speaker: Column) -> Column:
            before = F.get(order, (F.array_position(order, speaker) - 2).cast("int"))
            role = F.when(F.try_element_at(roles, before) == "user", "assistant").otherwise("user")
            return F.map_concat(roles, F.create_map(speaker, role))

        return F.aggregate(F.array_distinct(order), F.create_map().cast("map<string,string>"), add)

    def assign(rows: Column) -> Column:
        roles = let(F.transform(rows, lambda m: m["speaker"]), roles_of)
        return let(roles, lambda r: F.transform(rows, lambda m: _message(F.try_element_at(r, m["speaker"]), m["text"])))

    return let(let(said, assign), _at_least_two)


def messages_to_transcript(messages: Column, known_names: Iterable[str] = ()) -> Column:
    """``> user`` lines, answers below them, a blank line after every exchange.

    A user message and the assistant message right after it form one exchange; any
    other message stands alone.
    """
    names = list(known_names)

    def render(message: Column, i: Column) -> Column:
        user = message["role"] == "user"
        paired = user & F.coalesce(F.get(messages, i + 1)["role"] == "assistant", F.lit(False))
        line = F.when(user, F.concat(F.lit("> "), correct_text(message["text"], names))).otherwise(message["text"])
        return F.concat(line, F.when(paired, "\n").otherwise("\n\n"))

    text = F.array_join(F.transform(messages, render), "")
    return F.when(messages.isNotNull(), F.substring(text, F.lit(1), F.length(text) - 1))


def normalize_content(content: Column, extension: Column | None = None, known_names: Iterable[str] = ()) -> Column:
    """Plain transcript of a file in any known shape; unknown content passes unchanged."""
    names = list(known_names)
    suffix = F.lower(extension) if extension is not None else F.lit("")
    first = F.substring(trim(content), 1, 1)
    looks_json = suffix.isin(".json", ".jsonl") | first.isin("{", "[")
    entries = _json_lines(content)
    by_line = let(entries, lambda e: F.coalesce(typed_lines_messages(e), event_lines_messages(e)))
    # The branch of a node tree comes from an Arrow step, so it is bound beside the parsed document.
    shapes = F.struct(F.try_parse_json(content).alias("data"), branch_messages(content).alias("branch"))
    by_document = let(
        shapes,
        lambda s: F.coalesce(role_list_messages(s["data"]), _at_least_two(s["branch"]), channel_messages(s["data"])),
    )
    rendered = let(F.coalesce(by_line, by_document), lambda found: messages_to_transcript(found, names))
    return (
        F.when(is_blank(content), content)
        .when(quote_lines(content) >= 3, correct_transcript(content, names))
        .when(looks_json, let(rendered, lambda text: F.when(is_blank(text), content).otherwise(text)))
        .otherwise(content)
    )


def normalize(files: DataFrame, known_names: Iterable[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Add ``transcript``, ``status`` and ``reason`` to ``(path, content)``.

    Every file stays a row: one above ``max_bytes`` is ``rejected`` with its reason and has
    no transcript, all others are ``read``.
    """
    extension = F.concat(F.lit("."), F.substring_index("path", ".", -1))
    size = F.octet_length("content")
    rejected = size > max_bytes
    return (
        files.withColumn("status", F.when(rejected, "rejected").otherwise("read"))
        .withColumn("reason", F.when(rejected, F.format_string(f"file has %d bytes, the limit is {max_bytes}", size)))
        .withColumn("transcript", F.when(~rejected, normalize_content(F.col("content"), extension, known_names)))
    )


def transcript_lines(messages: DataFrame) -> DataFrame:
    """Transcript of message rows, turn by turn: ``(conv_id, turn, line)``.

    Joined in turn order, without the last line break, the lines are the transcript.
    Nothing is gathered, so this form suits conversations of any length.
    """
    block = F.floor(F.col("turn") / TURN_BLOCK)
    following = next_value(messages, ["conv_id"], ["turn"], block, "role", "_next_role")
    user = F.col("role") == "user"
    paired = user & F.coalesce(F.col("_next_role") == "assistant", F.lit(False))
    said = F.when(user, F.concat(F.lit("> "), correct_text(F.col("text")))).otherwise(F.col("text"))
    return following.select("conv_id", "turn", F.concat(said, F.when(paired, "\n").otherwise("\n\n")).alias("line"))


def conversation_messages(messages: DataFrame, part_turns: int | None = None) -> DataFrame:
    """Message rows gathered in turn order: ``(conv_id, part, messages)``.

    A conversation of any length is one row, ``part`` 0. Turns are gathered by blocks
    first, so the last step of a long conversation reads a row per block. With
    ``part_turns`` a conversation comes in numbered parts of so many turns instead; the
    caller then keeps them apart by ``part``.
    """
    part = F.lit(0) if part_turns is None else F.floor(F.col("turn") / part_turns).cast("int")
    block = F.floor(F.col("turn") / (part_turns or TURN_BLOCK)).alias("_block")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    numbered = messages.select("conv_id", part.alias("part"), block, "turn", "role", "text")
    blocks = keep_wide(numbered, "conv_id", "_block").groupBy("conv_id", "part", "_block").agg(
        F.transform(ordered, lambda m: _message(m["role"], m["text"])).alias("_messages")
    )
    joined = F.array_sort(F.collect_list(F.struct("_block", "_messages")))
    return blocks.groupBy("conv_id", "part").agg(F.flatten(F.transform(joined, lambda b: b["_messages"])).alias("messages"))


def _has_command(content: Column) -> Column:
    marked = F.exists(
        F.coalesce(_items(content), F.array().cast("array<variant>")),
        lambda item: F.coalesce(F.contains(_string(item, "$.text"), F.lit(COMMAND_MARK)), F.lit(False)),
    )
    return F.coalesce(F.contains(_string(content), F.lit(COMMAND_MARK)), F.lit(False)) | marked


def is_human_message(line: Column) -> Column:
    """A user message in either line format that is not a bare command; bad lines are not."""

    def test(entry: Column) -> Column:
        typed = (_string(entry, "$.message.role") == "user") & ~_has_command(_field(entry, "$.message.content"))
        event = (
            (_string(entry, "$.type") == "event_msg")
            & (_string(entry, "$.payload.type") == "user_message")
            & ~_has_command(_field(entry, "$.payload.message"))
        )
        return F.coalesce(typed, F.lit(False)) | F.coalesce(event, F.lit(False))

    return let(F.try_parse_json(line), test)


def count_human_messages(lines: DataFrame) -> DataFrame:
    """Human messages per session of ``(session, line)`` rows, combined before the shuffle."""
    return lines.groupBy("session").agg(F.count_if(is_human_message(F.col("line"))).alias("human_messages"))
