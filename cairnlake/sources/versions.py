"""Tables that merge on read: rows and tombstones are only ever added, versions are switched at once.

A change writes its new rows to a folder of ``data`` and the keys it takes away to a folder
of ``gone``, each with the number of its step, and then a manifest that lists all folders
of the new version. Readers see the newest manifest, so a change that stops before its
manifest is renamed into place leaves nothing but unused files. A tombstone takes away the
rows of earlier steps with its key. ``compact`` folds all steps into one; ``vacuum`` drops
folders that the kept versions do not name.

A change costs bytes in proportion to its own rows. Two writers at a time are told apart by
the number of their manifest: the later one fails and its change can be repeated.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP, GONE = "_step", "_gone"


class ConflictError(RuntimeError):
    """Another writer switched to the same version first."""


@dataclass(frozen=True)
class Staged:
    """Folders of a version that is written but not switched to."""

    version: int
    data: tuple[str, ...]
    gone: tuple[str, ...]


class VersionedTable:
    """Rows of ``schema`` under ``folder``; ``key`` names the columns that tombstones compare, null-safely.

    ``order`` sorts the rows of a file, so that column statistics skip files and row groups.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: list[str], order: list[str] | None = None):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self.order = order or key
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.folder}/manifest")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> Staged:
        """Folders of a version, the newest by default; an unwritten table has version 0 and none."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return Staged(0, (), ())
        stream = self._files.open(self._path(f"{self.folder}/manifest/{version}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Staged(version, tuple(held["data"]), tuple(held["gone"]))

    def switch(self, staged: Staged) -> None:
        """Make a staged version the newest by renaming its manifest into place."""
        target = self._path(f"{self.folder}/manifest/{staged.version}.json")
        draft = self._path(f"{self.folder}/manifest/{uuid4().hex}.draft")
        stream = self._files.create(draft, False)
        stream.write(json.dumps({"data": staged.data, "gone": staged.gone}).encode())
        stream.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise ConflictError(f"version {staged.version} of {self.folder} is taken")

    # Reading

    def read(self, version: int | Staged | None = None) -> DataFrame:
        """Rows of the newest version, of an earlier one, or of one that is only staged."""
        held = version if isinstance(version, Staged) else self.manifest(version)
        names = self.schema.fieldNames()
        if not held.data:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(STEP, T.LongType())])).parquet(*held.data)
        if not held.gone:
            return rows.select(names)
        marks = T.StructType([*(self.schema[name] for name in self.key), T.StructField(GONE, T.LongType())])
        latest = (
            self.spark.read.schema(marks).parquet(*held.gone).groupBy(*[F.col(k).alias(f"_{k}") for k in self.key]).agg(F.max(GONE).alias(GONE))
        )
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key] + [F.col(STEP) < F.col(GONE)]
        return rows.join(latest, same, "left_anti").select(names)

    # Writing

    def stage(self, added: DataFrame | None = None, gone: DataFrame | None = None, afresh: bool = False) -> Staged:
        """Write a change without switching to it; ``afresh`` leaves all earlier rows out."""
        before = self.manifest()
        step = before.version + 1
        data, marks = ([], []) if afresh else (list(before.data), list(before.gone))
        if added is not None:
            data.append(f"{self.folder}/data/{uuid4().hex}")
            rows = self._shaped(added).withColumn(STEP, F.lit(step).cast("long"))
            rows.hint("rebalance").sortWithinPartitions(*self.order).write.parquet(data[-1])
        if gone is not None:
            marks.append(f"{self.folder}/gone/{uuid4().hex}")
            keys = gone.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.key]).distinct()
            keys.withColumn(GONE, F.lit(step).cast("long")).hint("rebalance").write.parquet(marks[-1])
        return Staged(step, tuple(data), tuple(marks))

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """All columns of the schema; missing ones are NULL."""
        return rows.select(
            [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        )

    def commit(self, added: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Take away the rows with a key in ``gone``, add ``added``; returns the new version."""
        staged = self.stage(added, gone)
        self.switch(staged)
        return staged.version

    def replace(self, rows: DataFrame) -> int:
        staged = self.stage(rows, afresh=True)
        self.switch(staged)
        return staged.version

    def compact(self) -> int:
        """Fold all steps into one set of files in order of ``order``; the rows stay the same."""
        before = self.manifest()
        step = before.version + 1
        folder = f"{self.folder}/data/{uuid4().hex}"
        ordered = self.read().repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        ordered.withColumn(STEP, F.lit(step).cast("long")).write.parquet(folder)
        self.switch(Staged(step, (folder,), ()))
        return step

    def rollback(self, version: int) -> int:
        """Make the rows of an earlier version the newest again."""
        old = self.manifest(version)
        step = max(self.versions()) + 1
        self.switch(Staged(step, old.data, old.gone))
        return step

    def drop_after(self, version: int) -> None:
        """Forget versions beyond ``version``; their folders go with the next ``vacuum``."""
        for later in self.versions():
            if later > version:
                self._files.delete(self._path(f"{self.folder}/manifest/{later}.json"), False)

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the newest ``keep`` versions names, and older manifests; returns their number."""
        versions = self.versions()
        used = {name for version in versions[-keep:] for held in [self.manifest(version)] for name in (*held.data, *held.gone)}
        names = {folder.rsplit("/", 1)[-1] for folder in used}
        dropped = 0
        for kind in ("data", "gone"):
            folder = self._path(f"{self.folder}/{kind}")
            if self._files.exists(folder):
                for status in self._files.listStatus(folder):
                    if status.getPath().getName() not in names:
                        dropped += bool(self._files.delete(status.getPath(), True))
        for version in versions[:-keep]:
            self._files.delete(self._path(f"{self.folder}/manifest/{version}.json"), False)
        return dropped
