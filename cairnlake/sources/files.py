"""Project and conversation files as DataFrames, with ignore rules judged in the row of a path."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairnlake.functions import lexicons as lex
from cairnlake.functions.partitions import deal_reads
from cairnlake.functions.text import trim
from cairnlake.session import cut_lineage

# Fixed value: larger project files are not read.
MAX_PROJECT_BYTES = 10 * 1024 * 1024
IGNORE_FILE = ".gitignore"
READ_BATCH_CHARS, READ_BATCH_FILES = 4 << 20, 1_000


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and root of a path or URI; runs inside tasks."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def list_files(
    spark: SparkSession, folder: str, pruned: Iterable[str] = (), kept: Iterable[str] = ()
) -> DataFrame:
    """``(path, absolute_path, size, mtime)`` of all files below a folder, path relative to it.

    Hidden files count, symbolic links do not. The tree is listed level by level, the
    folders of a level in parallel; a folder named in ``pruned`` is not entered unless
    it lies on the way to or below one of ``kept``.
    """
    pruned, kept = list(pruned), list(kept)

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(folder)
        for batch in batches:
            rows = []
            for parent in batch["path"]:
                base = f"{root}/{parent}" if parent else root
                for info in system.get_file_info(fs.FileSelector(base)):
                    if isinstance(system, fs.LocalFileSystem) and os.path.islink(info.path):
                        continue
                    name = f"{parent}/{info.base_name}" if parent else info.base_name
                    is_folder = info.type == fs.FileType.Directory
                    rows.append((name, info.path, is_folder, info.size or 0, (info.mtime_ns or 0) // 1_000_000))
            yield pd.DataFrame(rows, columns=["path", "absolute_path", "is_folder", "size", "mtime"])

    schema = "path string, absolute_path string, is_folder boolean, size long, mtime long"
    level = spark.createDataFrame([("",)], "path string")
    levels: list[DataFrame] = []
    name = F.substring_index("path", "/", -1)
    skipped = (name.isin(pruned) | name.endswith(".egg-info")) & ~included(F.col("path"), kept)
    while True:
        listed = cut_lineage(level.mapInPandas(children, schema))
        levels.append(listed.where(~F.col("is_folder")).drop("is_folder"))
        level = listed.where(F.col("is_folder") & (~skipped if pruned else F.lit(True))).select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        level = deal_reads(level, "path")


def read_contents(folder: str, paths: DataFrame) -> DataFrame:
    """Add ``content`` to listed files, read inside the tasks; a leading byte order mark is dropped."""
    schema = T.StructType([*paths.schema.fields, T.StructField("content", T.StringType())])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(row["absolute_path"]) as stream:
                    text = stream.read().decode("utf-8", errors="replace")
                rows.append({**row, "content": text.removeprefix("\ufeff")})
                held += len(text)
                # Small files leave the task together, a large one does not wait for others.
                if held >= READ_BATCH_CHARS or len(rows) >= READ_BATCH_FILES:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return deal_reads(paths, "absolute_path").mapInArrow(read, schema)


def _folders(path: Column) -> Column:
    return F.slice(F.split(path, "/", -1), F.lit(1), F.size(F.split(path, "/", -1)) - 1)


def _suffix(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """Rules of ``(folder, content)`` ignore files: ``(folder, ord, regex, negated, folders_only)``.

    Every rule becomes one regular expression over ``part/part/.../``: a rule of one
    unanchored segment matches any part; any other matches from the folder down, and a
    matching beginning is enough. ``*`` and ``?`` stay inside a part, ``**`` spans parts.
    """
    lines = ignore_files.select("folder", F.posexplode(F.split("content", "\r?\n", -1)).alias("ord", "raw"))
    escaped = F.col("line").startswith("\\#") | F.col("line").startswith("\\!")
    parsed = (
        lines.withColumn("line", trim(F.col("raw")))
        .where(F.col("line") != "")
        .where(~F.col("line").startswith("#"))
        .withColumn("body", F.when(escaped, F.substr("line", F.lit(2))).otherwise(F.col("line")))
        .withColumn("negated", F.col("body").startswith("!"))
        .withColumn("body", F.when(F.col("negated"), F.substr("body", F.lit(2))).otherwise(F.col("body")))
        .withColumn("anchored", F.col("body").startswith("/"))
        .withColumn("body", F.ltrim("body", F.lit("/")))
        .withColumn("folders_only", F.col("body").endswith("/"))
        .withColumn("body", F.rtrim("body", F.lit("/")))
        .where(F.col("body") != "")
    )
    parts = F.filter(F.split("body", "/", -1), lambda part: part != "")

    def glob(part: Column) -> Column:
        quoted = F.regexp_replace(part, r"([\\.\[\]{}()+^$|#-])", r"\\$1")
        return F.regexp_replace(F.regexp_replace(quoted, r"\*+", "[^/]*"), r"\?", "[^/]")

    steps = F.transform(
        parts, lambda part: F.when(part == "**", F.lit("(?:[^/]+/)*")).otherwise(F.concat(glob(part), F.lit("/")))
    )
    rooted = F.col("anchored") | (F.size(parts) > 1)
    regex = F.when(rooted, F.concat(F.lit("^"), F.array_join(steps, ""))).otherwise(
        F.concat(F.lit("(?:^|/)"), glob(F.col("body")), F.lit("/"))
    )
    return parsed.select("folder", "ord", regex.alias("regex"), "negated", "folders_only")


def rule_sets(rules: DataFrame) -> DataFrame:
    """The rules of each folder as one array in order; neighbours of one effect become one expression."""
    place = F.row_number().over(Window.partitionBy("folder").orderBy("ord"))
    alike = F.row_number().over(Window.partitionBy("folder", "negated", "folders_only").orderBy("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "regex")))
    either = F.array_join(F.transform(ordered, lambda r: F.concat(F.lit("(?:"), r["regex"], F.lit(")"))), "|")
    runs = rules.withColumn("_run", place - alike).groupBy("folder", "negated", "folders_only", "_run")
    merged = runs.agg(F.max("ord").alias("ord"), either.alias("regex"))
    return merged.groupBy("folder").agg(
        F.array_sort(F.collect_list(F.struct("ord", "regex", "negated", "folders_only"))).alias("rules")
    )


def _rules_below(base: Column, rules: Column) -> Column:
    return F.transform(
        rules,
        lambda r: F.struct(
            base.cast("int").alias("base"), r["regex"].alias("regex"), r["negated"].alias("negated"), r["folders_only"].alias("folders_only")
        ),
    )


def _is_ignored(parts: Column, rules: Column) -> Column:
    """One path, or a folder on its way, is ignored by ``rules`` in order from the root down."""

    def matches(rule: Column, depth: Column) -> Column:
        below = F.slice(parts, rule["base"] + 1, depth - rule["base"])
        # A folder rule looks at the folders of a file only.
        above = F.slice(below, F.lit(1), F.greatest(F.size(below) - 1, F.lit(0)))
        seen = F.when(rule["folders_only"] & (depth == F.size(parts)), above).otherwise(below)
        return (F.size(seen) > 0) & F.rlike(F.concat(F.array_join(seen, "/"), F.lit("/")), rule["regex"])

    def judged(depth: Column) -> Column:
        hits = F.filter(rules, lambda r: F.when(r["base"] < depth, matches(r, depth)).otherwise(False))
        return F.coalesce(~F.try_element_at(hits, F.lit(-1))["negated"], F.lit(False))

    return F.exists(F.sequence(F.lit(1), F.size(parts)), judged)


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``path`` values that are ignored, themselves or through a folder above them.

    Each path is judged in its row, together with every folder on its way. A rule file
    applies to what lies below it; the deepest rule file with an opinion wins, inside a
    file the last matching rule. The rules on the way are looked up once per folder; those
    of the root, which all paths share, are one value and no join key.
    """
    sets = rule_sets(rules)
    placed = paths.where(F.col("path").isNotNull()).select("path", F.array_join(_folders(F.col("path")), "/").alias("folder"))
    parts = F.split("folder", "/", -1)
    steps = placed.select("folder").distinct().where("folder <> ''").select("folder", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("base"))
    above = steps.select("folder", "base", F.array_join(F.slice("parts", F.lit(1), F.col("base")), "/").alias("holder"))
    found = above.join(sets.where("folder <> ''").select(F.col("folder").alias("holder"), "rules"), "holder")
    chain = F.array_sort(F.collect_list(F.struct("base", _rules_below(F.col("base"), F.col("rules")).alias("rules"))))
    chains = found.groupBy("folder").agg(F.flatten(F.transform(chain, lambda c: c["rules"])).alias("chain"))
    root = sets.where("folder = ''").select(_rules_below(F.lit(0), F.col("rules"))).scalar()
    none = F.array().cast("array<struct<base:int,regex:string,negated:boolean,folders_only:boolean>>")
    rules_of = F.concat(F.coalesce(root, none), F.coalesce(F.col("chain"), none))
    judged = placed.join(chains, "folder", "left").withColumn("rules", rules_of)
    return judged.where(_is_ignored(F.split("path", "/", -1), F.col("rules"))).select("path").distinct()


def included(path: Column, force_included: Iterable[str]) -> Column:
    """The path is a forced one, lies below one, or leads to one."""
    hit = F.lit(False)
    for forced in force_included:
        hit = hit | (path == forced) | path.startswith(f"{forced}/") | F.startswith(F.lit(forced), F.concat(path, F.lit("/")))
    return hit


def project_files(
    files: DataFrame,
    rules: DataFrame | None = None,
    force_included: Iterable[str] = (),
    suffixes: list[str] = lex.PROJECT_SUFFIXES,
    max_bytes: int = MAX_PROJECT_BYTES,
) -> DataFrame:
    """Readable project files of a listing: suffix, size, skipped folders and ignore rules applied."""
    forced = [part.strip().strip("/") for part in force_included if part.strip().strip("/")]
    path = F.col("path")
    exact = path.isin(forced) if forced else F.lit(False)
    is_forced = included(path, forced)
    skipped = F.exists(
        _folders(path), lambda folder: folder.isin(lex.SKIPPED_FOLDERS) | folder.endswith(".egg-info")
    )
    named = F.substring_index(path, "/", -1).isin(lex.SKIPPED_FILES)
    kept = files.where(
        (F.col("size") <= max_bytes)
        & (is_forced | (~skipped & ~named))
        & (_suffix(path).isin(suffixes) | exact)
    )
    if rules is None:
        return kept
    gone = ignored_paths(kept.where(~is_forced).select("path"), rules)
    return kept.join(gone, "path", "left_anti")


def rejected_files(files: DataFrame, max_bytes: int = MAX_PROJECT_BYTES) -> DataFrame:
    """Listed files that a project leaves out for their size: ``(path, size, status, reason)``."""
    return files.where(F.col("size") > max_bytes).select(
        "path",
        "size",
        F.lit("rejected").alias("status"),
        F.format_string(f"file has %d bytes, the limit is {max_bytes}", "size").alias("reason"),
    )


def conversation_files(files: DataFrame) -> DataFrame:
    """Transcript files of a listing."""
    path = F.col("path")
    skipped = F.exists(_folders(path), lambda folder: folder.isin(lex.CONVERSATION_SKIPPED_FOLDERS))
    return files.where(
        F.lower(_suffix(path)).isin(lex.CONVERSATION_SUFFIXES) & ~F.lower(path).endswith(".meta.json") & ~skipped
    )


def scan_project(
    spark: SparkSession, folder: str, respect_ignore: bool = True, force_included: Iterable[str] = ()
) -> DataFrame:
    """Project files of a folder with the ignore files found in it."""
    forced = [part.strip().strip("/") for part in force_included if part.strip().strip("/")]
    listed = list_files(spark, folder, lex.SKIPPED_FOLDERS, forced)
    rules = None
    if respect_ignore:
        found = listed.where(F.substring_index("path", "/", -1) == IGNORE_FILE)
        holder = F.array_join(_folders(F.col("path")), "/")
        rules = ignore_rules(read_contents(folder, found).select(holder.alias("folder"), "content"))
    return project_files(listed, rules, forced)


def write_sessions(sessions: DataFrame, folder: str) -> None:
    """Write each split session as text below a folder named after its file name."""
    sessions.select("file_name", "content").write.mode("overwrite").partitionBy("file_name").text(folder)


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Top-level text files as ``(path, content)``."""
    texts = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
