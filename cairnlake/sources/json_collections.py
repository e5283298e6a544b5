"""Exported collection documents, each read by many tasks.

A document is one JSON object with its drawers in an array, so it has no line that a
reader could split at, and whether a byte lies inside a string depends on all bytes before
it. Every block of a file is therefore summed up twice, as if it began inside and outside
a string: parity of quotes, change and minimum of depth. One small row per block then
settles where each block truly begins, and the blocks are parsed side by side. A drawer
belongs to the block it begins in; its task reads on to the drawer's end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairnlake.functions.partitions import deal_reads
from cairnlake.schema import DRAWER_SCHEMA
from cairnlake.session import cut_lineage

BLOCK_BYTES = 8 << 20
READ_ON_BYTES = 1 << 20
#: Rows and bytes that a task hands over at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
QUOTE, BACKSLASH = ord('"'), ord("\\")
OPENING, CLOSING = (ord("{"), ord("[")), (ord("}"), ord("]"))
#: Depths inside the document, inside the array of drawers and inside a drawer.
IN_DOCUMENT, IN_ARRAY, IN_DRAWER = 1, 2, 3
ARRAY_NAME = "drawers"

REPORT = [T.StructField("path", T.StringType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())]
READ_SCHEMA = T.StructType([*[T.StructField(f.name, f.dataType) for f in DRAWER_SCHEMA], *REPORT])
BLOCKS = "path string, start long, stop long"
SUMMARIES = f"{BLOCKS}, quotes int, change_out int, change_in int, lowest_out int, lowest_in int"


class Brackets(NamedTuple):
    """Brackets outside strings of some bytes: places, depths behind them, and the state at the end."""

    place: np.ndarray
    depth: np.ndarray
    opens: np.ndarray
    in_string: bool
    end_depth: int


def _quotes(data: np.ndarray, slashes: int) -> np.ndarray:
    """Places of the quotes that no backslash escapes; ``slashes`` stand right before the bytes."""
    places = np.flatnonzero(data == QUOTE)
    if slashes == 0 and not (data == BACKSLASH).any():
        return places
    other = np.flatnonzero(data != BACKSLASH)
    # Backslashes between the quote and the last other byte before it.
    before = np.searchsorted(other, places) - 1
    run = np.where(before >= 0, places - 1 - other[np.maximum(before, 0)], places + slashes)
    return places[run % 2 == 0]


def _brackets(data: np.ndarray, quotes: np.ndarray, in_string: bool, depth: int) -> Brackets:
    opens, closes = np.isin(data, OPENING), np.isin(data, CLOSING)
    place = np.flatnonzero(opens | closes)
    outside = (np.searchsorted(quotes, place) + in_string) % 2 == 0
    place = place[outside]
    step = np.where(opens[place], 1, -1)
    depths = depth + np.cumsum(step)
    end = int(depths[-1]) if len(depths) else depth
    return Brackets(place, depths, step > 0, (len(quotes) + in_string) % 2 == 1, end)


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inside = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(inside)


def _slashes_before(file: pa.NativeFile, start: int) -> int:
    """Length of the run of backslashes that ends right before ``start``."""
    run, end = 0, start
    while end > 0:
        piece = file.read_at(min(4096, end), max(0, end - 4096))
        kept = len(piece.rstrip(b"\\"))
        run += len(piece) - kept
        if kept:
            break
        end -= len(piece)
    return run


def _load(file: pa.NativeFile, start: int, stop: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    raw = file.read_at(stop - start, start)
    data = np.frombuffer(raw, dtype=np.uint8)
    return raw, data, _quotes(data, _slashes_before(file, start))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for batch in batches:
        yield from batch.to_pylist()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows_of(batches):
        with _open(row["path"]) as file:
            _, data, quotes = _load(file, row["start"], row["stop"])
        outside, inside = _brackets(data, quotes, False, 0), _brackets(data, quotes, True, 0)
        lowest = [int(found.depth.min(initial=0)) for found in (outside, inside)]
        values = [*row.values(), len(quotes) % 2, outside.end_depth, inside.end_depth, *lowest]
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 5]
        names = ["path", "start", "stop", "quotes", "change_out", "change_in", "lowest_out", "lowest_in"]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)


def _name_before(file: pa.NativeFile, place: int) -> str:
    """The property name that stands before the bracket at ``place``, lower-cased; blank without one."""
    size = 256
    while True:
        head = file.read_at(min(size, place), max(0, place - size)).rstrip()
        named = head[:-1].rstrip() if head.endswith(b":") else b""
        if not named.endswith(b'"'):
            return ""
        opening = named[:-1].rfind(b'"')
        if opening >= 0:
            return named[opening + 1 : -1].decode("utf-8", "replace").lower()
        if size >= place:
            return ""
        size *= 2


def _arrays(file: pa.NativeFile, start: int, found: Brackets, data: np.ndarray) -> list[tuple[int, bool]]:
    """``(place, is the drawers' array)`` of every value that opens right below the document."""
    tops = np.flatnonzero(found.opens & (found.depth == IN_ARRAY))
    places = found.place[tops].tolist()
    return [(p, bool(data[p] == ord("[")) and _name_before(file, start + p) == ARRAY_NAME) for p in places]


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For blocks that reach down to the document: is the last array opened in it that of the drawers."""
    for row in _rows_of(batches):
        with _open(row["path"]) as file:
            _, data, quotes = _load(file, row["start"], row["stop"])
            opened = _arrays(file, row["start"], _brackets(data, quotes, row["in_string"], row["depth"]), data)
        arrays = [pa.array([row["path"]]), pa.array([row["start"]], pa.int64()), pa.array([opened[-1][1] if opened else None], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, ["path", "start", "opened"])


def _property(name: str) -> str:
    return {"source_mtime": "sourcemtimeutcms"}.get(name, name.replace("_", ""))


def _value(field: T.StructField, found: Any) -> Any:
    """A field's value; text of other types is its JSON, numbers of other types or sizes are missing."""
    if isinstance(field.dataType, T.StringType):
        text = found if found is None or isinstance(found, str) else json.dumps(found, ensure_ascii=False)
        text = None if text is None else text.encode("utf-8", "replace").decode()
        return (text or None) if field.nullable else (text or "")
    number = found if isinstance(found, (int, float)) and not isinstance(found, bool) else None
    if isinstance(field.dataType, T.DoubleType):
        return None if number is None else float(number)
    bits = 63 if isinstance(field.dataType, T.LongType) else 31
    whole = number if isinstance(number, int) and -(1 << bits) <= number < (1 << bits) else None
    return whole if field.nullable or whole is not None else 0


def _drawer(raw: bytes) -> tuple[dict[str, Any] | None, str | None]:
    """The row of one drawer, or the reason why it is rejected."""
    try:
        parsed = json.loads(raw.decode("utf-8", "replace"))
    except (ValueError, RecursionError) as problem:
        return None, f"no valid JSON: {problem}"
    top = {key.lower(): value for key, value in parsed.items()}
    metadata = top.get("metadata")
    values = {key.lower(): value for key, value in metadata.items()} if isinstance(metadata, dict) else {}
    values.update(id=top.get("id"), text=top.get("text"))
    if not isinstance(values["id"], str) or not values["id"]:
        return None, "no Id"
    return {field.name: _value(field, values.get(_property(field.name))) for field in DRAWER_SCHEMA}, None


def _end_of_drawer(file: pa.NativeFile, at: int, found: Brackets, size: int) -> tuple[bytes, bool]:
    """Bytes from ``at`` to the end of a drawer that is still open there; False when the file ends first."""
    pieces, in_string, depth = [], found.in_string, found.end_depth
    while at < size:
        stop = min(size, at + READ_ON_BYTES)
        raw, data, quotes = _load(file, at, stop)
        here = _brackets(data, quotes, in_string, depth)
        closed = np.flatnonzero(~here.opens & (here.depth == IN_ARRAY))
        if len(closed):
            return b"".join([*pieces, raw[: here.place[closed[0]] + 1]]), True
        pieces.append(raw)
        in_string, depth, at = here.in_string, here.end_depth, stop
    return b"".join(pieces), False


def _drawers_of(row: dict[str, Any]) -> Iterator[bytes]:
    """The drawers that begin in one block."""
    start = row["start"]
    with _open(row["path"]) as file:
        size = file.size()
        raw, data, quotes = _load(file, start, row["stop"])
        found = _brackets(data, quotes, row["in_string"], row["depth"])
        arrays = _arrays(file, start, found, data)
        begins = np.flatnonzero(found.opens & (found.depth == IN_DRAWER) & (data[found.place] == ord("{")))
        ends = found.place[np.flatnonzero(~found.opens & (found.depth == IN_ARRAY))]
        marks = np.array([place for place, _ in arrays], dtype=np.int64)
        for begin in found.place[begins].tolist():
            mark = int(np.searchsorted(marks, begin)) - 1
            if not (arrays[mark][1] if mark >= 0 else row["in_drawers"]):
                continue
            end = int(np.searchsorted(ends, begin))
            if end < len(ends):
                yield raw[begin : ends[end] + 1]
            else:
                rest, closed = _end_of_drawer(file, row["stop"], found, size)
                # A document that ends inside a drawer is reported as a whole.
                if closed:
                    yield raw[begin:] + rest


def _reader(wing: str | None, room: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = to_arrow_schema(READ_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for block in _rows_of(batches):
            for raw in _drawers_of(block):
                drawer, problem = _drawer(raw)
                if drawer is not None and ((wing is not None and drawer["wing"] != wing) or (room is not None and drawer["room"] != room)):
                    continue
                status = "read" if problem is None else "rejected"
                rows.append({**(drawer or {}), "path": block["path"], "status": status, "reason": problem})
                held += len(raw)
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size)`` of a file, a folder or a pattern; nothing where there is none."""
    try:
        # Without its content column the reader lists files and opens none.
        return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, size long")


def block_states(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``(path, size)`` files with the state they begin in.

    ``in_string`` and ``depth`` hold at ``start``; ``end_depth`` and ``ends_in_string`` at
    ``stop``; ``in_drawers`` tells whether the array of drawers is the last one opened.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))
    blocks = files.where("size > 0").select("path", "size", F.explode(starts).alias("start"))
    blocks = blocks.select("path", "start", F.least("size", F.col("start") + block_bytes).alias("stop"))
    # One row per block from here on; kept, so that no later step reads the files for them again.
    summed = cut_lineage(deal_reads(blocks, "path", "start").mapInArrow(_summaries, SUMMARIES))
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("quotes").over(before), F.lit(0))
    known = summed.withColumn("in_string", quotes % 2 == 1).withColumn("ends_in_string", (quotes + F.col("quotes")) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("change_in")).otherwise(F.col("change_out"))
    lowest = F.when(F.col("in_string"), F.col("lowest_in")).otherwise(F.col("lowest_out"))
    known = known.withColumn("change", change).withColumn("lowest", lowest)
    known = known.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)).cast("int"))
    known = known.withColumn("end_depth", (F.col("depth") + F.col("change")).cast("int"))
    known = known.withColumn("last", F.lead("start").over(order).isNull())
    kept = known.select("path", "start", "stop", "in_string", "ends_in_string", "depth", "end_depth", "lowest", "last")
    # What a file's last block opens is of no use to any other, so files of one block are not read for it.
    shallow = deal_reads(kept.where((F.col("depth") + F.col("lowest") <= IN_DOCUMENT) & ~F.col("last")), "path", "start")
    opened = shallow.mapInArrow(_sections, "path string, start long, opened boolean")
    section = F.last("opened", ignorenulls=True).over(before)
    states = kept.join(opened, ["path", "start"], "left").withColumn("in_drawers", F.coalesce(section, F.lit(False)))
    # Kept as well: the drawers and the report on whole files both ask for them.
    return cut_lineage(states.drop("opened", "lowest", "last"))


def read_collections(
    spark: SparkSession, path: str, wing: str | None = None, room: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Drawers of exported documents ``{Name, Drawers: [{Id, Text, Metadata}]}`` with ``path``, ``status``, ``reason``.

    ``path`` names a file, a folder or a pattern; none at all, or an empty one, reads as no
    rows. Names are matched without regard to case. Drawers of another ``wing`` or ``room``
    do not leave the task. Drawers that are no valid JSON or have no Id, and whole files that
    end inside a string or bracket, are rows too, ``rejected`` with their reason; the whole
    drawers of such a file are read all the same. Elements that are no objects do not count.
    """
    files = _files(spark, path)
    states = block_states(files, block_bytes)
    drawers = deal_reads(states, "path", "start").mapInArrow(_reader(wing, room), READ_SCHEMA)
    end = F.max_by(F.struct("ends_in_string", "end_depth"), "start")
    ends = states.groupBy("path").agg(end.alias("end")).select("path", "end.*")
    bad = ends.select(
        "path",
        F.when(F.col("ends_in_string"), "ends inside a string")
        .when(F.col("end_depth") > 0, "ends inside a bracket")
        .when(F.col("end_depth") < 0, "closes more brackets than it opens")
        .alias("reason"),
    ).where(F.col("reason").isNotNull())
    rejected = bad.select("path", F.lit("rejected").alias("status"), "reason")
    return drawers.unionByName(rejected, allowMissingColumns=True)
