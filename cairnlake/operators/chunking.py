"""Text chunks: sized windows of prose, exchanges and paragraphs of transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.functions.arrays import groups_from, positions
from cairnlake.functions.partitions import posexplode_rows
from cairnlake.functions.text import is_blank, let, lines_of, trim, trim_start

# Fixed sizes.
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 800, 100, 50
MIN_EXCHANGE = 30
REPLY_LINES = 8
LINE_GROUP = 25
BATCH_CHARS = 4 << 20


def text_pieces(text: str, size: int, overlap: int, minimum: int) -> Iterator[str]:
    """Windows of at most ``size`` characters, each ending at a late paragraph or line break if there is one."""
    text = text.strip()
    start, length = 0, len(text)
    while start < length:
        end = min(start + size, length)
        if end < length:
            middle = start + size // 2
            # First choice that lies past the middle wins: blank line, then line break.
            for mark in ("\n\n", "\n"):
                at = text.rfind(mark, start, end)
                if at > middle:
                    end = at
                    break
        piece = text[start:end].strip()
        if len(piece) >= minimum:
            yield piece
        if end >= length:
            return
        start = max(end - overlap, start + 1)


def chunk_text(
    df: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    minimum: int = MIN_CHUNK,
) -> DataFrame:
    """One row per chunk: the columns of ``df`` without ``text``, then ``chunk_index`` and ``content``.

    Where a chunk starts depends on where the one before ended, so each text is walked
    once inside an Arrow batch; there is no shuffle.
    """
    kept = [name for name in df.columns if name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = batch.column(text), 0
            rows: list[int] = []
            index: list[int] = []
            pieces: list[str] = []

            def made() -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())
                columns = [batch.column(name).take(take) for name in kept]
                return pa.RecordBatch.from_arrays(
                    [*columns, pa.array(index, pa.int32()), pa.array(pieces, pa.string())],
                    names=[*kept, "chunk_index", "content"],
                )

            for row in range(batch.num_rows):
                for number, piece in enumerate(text_pieces(texts[row].as_py() or "", size, overlap, minimum)):
                    rows.append(row)
                    index.append(number)
                    pieces.append(piece)
                    held += len(piece)
                    # Chunks leave in portions, however many texts a batch holds.
                    if held >= BATCH_CHARS:
                        yield made()
                        held = 0
                        for column in (rows, index, pieces):
                            column.clear()
            if rows:
                yield made()

    fields = [df.schema[name] for name in kept]
    schema = T.StructType(
        [*fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())]
    )
    return df.mapInArrow(run, schema)


def paragraphs(content: Column) -> Column:
    """Non-empty trimmed pieces between blank lines."""
    pieces = F.transform(F.split(content, "\r\n\r\n|\n\n", -1), trim)
    return F.filter(pieces, lambda piece: piece != "")


def line_groups(content: Column) -> Column:
    """Trimmed groups of consecutive lines."""

    def cut(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(LINE_GROUP))
        return F.transform(groups_from(lines, starts), lambda group: trim(F.array_join(group, "\n")))

    return let(lines_of(content), cut)


def _exchanges(lines: Column) -> Column:
    """One chunk per ``>`` line with the first reply lines below it, up to the next ``>`` or rule."""
    starts = positions(lines, lambda line: F.startswith(trim_start(line), F.lit(">")))

    def render(block: Column) -> Column:
        reply = F.transform(F.slice(block, 2, F.greatest(F.size(block) - 1, F.lit(0))), trim)
        rule = F.array_position(F.transform(reply, lambda line: F.startswith(line, F.lit("---"))), True)
        before = F.when(rule > 0, F.slice(reply, F.lit(1), (rule - 1).cast("int"))).otherwise(reply)
        said = F.slice(F.filter(before, lambda line: line != ""), 1, REPLY_LINES)
        question = trim(F.get(block, F.lit(0)))
        return F.when(F.size(said) > 0, F.concat(question, F.lit("\n"), F.array_join(said, " "))).otherwise(question)

    return let(starts, lambda at: F.transform(groups_from(lines, at), render))


def exchange_chunks(content: Column) -> Column:
    """Chunks of a transcript: exchanges when it has three ``>`` lines, else paragraphs or line groups."""

    def choose(lines: Column) -> Column:
        quotes = F.size(F.filter(lines, lambda line: F.startswith(trim_start(line), F.lit(">"))))
        by_paragraph = let(
            paragraphs(content),
            lambda pieces: F.when((F.size(pieces) <= 1) & (F.size(lines) > 21), line_groups(content)).otherwise(pieces),
        )
        return F.when(quotes >= 3, _exchanges(lines)).otherwise(by_paragraph)

    chunks = F.filter(let(lines_of(content), choose), lambda chunk: F.length(trim(chunk)) > MIN_EXCHANGE)
    return F.when(is_blank(content), F.array().cast("array<string>")).otherwise(chunks)


def explode_chunks(df: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk with its position among the emitted ones."""
    return posexplode_rows(df, chunks, "chunk_index", "content", "*")
