"""Split sessions as files of their exact names, all or none of a run's tasks at a time.

Tasks write to a staging folder below the target, one file per session; only when every
task has committed are the files moved to their names and the sources set aside. A run
that fails while tasks write leaves the target as it was. One that fails while files are
moved can be repeated: the sources that are not set aside give the same names again.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.session import cut_lineage

#: Fixed value: ending of a source whose sessions are written.
SET_ASIDE = ".mega_backup"


@dataclass(frozen=True)
class SessionReport:
    sessions: int
    sources: int


def distinct_names(sessions: DataFrame) -> DataFrame:
    """``sessions`` whose ``file_name`` is unique: the first by path and number keeps its name, others get a count."""
    place = F.row_number().over(Window.partitionBy("file_name").orderBy("path", "number"))
    stem = F.regexp_replace("file_name", r"\.txt$", "")
    counted = sessions.withColumn("_place", place)
    # A count stands before a hash of the session, so that no given name meets it.
    mark = F.substring(F.md5(F.concat_ws("|", "path", "number")), 1, 12)
    others = F.concat(stem, F.lit("-"), F.col("_place"), F.lit("-"), mark, F.lit(".txt"))
    return counted.withColumn("file_name", F.when(F.col("_place") == 1, F.col("file_name")).otherwise(others)).drop("_place")


def aside_name(path: Column) -> Column:
    """The path with its last extension replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(SET_ASIDE))


def save_sessions(sessions: DataFrame, folder: str, set_aside: bool = True) -> SessionReport:
    """Write ``(path, number, file_name, content)`` sessions into ``folder``; their sources are renamed after that.

    A file of the same name from an earlier run is replaced. Contents travel from tasks to
    files; the driver only renames, one call per file.
    """
    spark = sessions.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = folder.rstrip("/")
    files = paths(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging = f"{root}/_staging-{uuid4().hex}"
    try:
        named = distinct_names(sessions.select("path", "number", "file_name", "content"))
        # The name stands beside the file as a partition of a number, so any character of it survives.
        keyed = cut_lineage(named.withColumn("_session", F.md5("file_name")))
        keyed.select("content", "_session").repartition("_session").write.partitionBy("_session").text(staging)
        names = keyed.select("_session", "file_name").toLocalIterator()
        moved = 0
        for row in names:
            parts = files.globStatus(paths(f"{staging}/_session={row['_session']}/part-*"))
            target = paths(f"{root}/{row['file_name']}")
            files.delete(target, False)
            if not files.rename(parts[0].getPath(), target):
                raise OSError(f"cannot move a session to {target.toString()}")
            moved += 1
        aside = 0
        if set_aside:
            for row in keyed.select("path", aside_name(F.col("path")).alias("aside")).distinct().toLocalIterator():
                source, kept = paths(row["path"]), paths(row["aside"])
                if files.exists(source):
                    files.delete(kept, False)
                    aside += bool(files.rename(source, kept))
        return SessionReport(moved, aside)
    finally:
        files.delete(paths(staging), True)
