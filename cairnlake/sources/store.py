"""Collections of drawers, and other keyed tables, as versioned tables below one database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.operators import mutations
from cairnlake.schema import DRAWER_SCHEMA
from cairnlake.sources.json_collections import read_collections
from cairnlake.sources.versions import VersionedTable


class Collections:
    """Named drawer tables of one catalog database; their files lie in the folder of the database.

    Every change is one new version: it writes its own rows and tombstones only, and a
    change that stops half-way leaves the version before it.
    """

    def __init__(self, spark: SparkSession, database: str = "default") -> None:
        self.spark = spark
        self.database = database
        self.folder = spark.catalog.getDatabase(database).locationUri.rstrip("/") + "/_collections"

    def list(self) -> list[str]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(name for name in names if self.exists(name))

    def table(self, name: str, schema: T.StructType = DRAWER_SCHEMA, key: list[str] | None = None) -> VersionedTable:
        """The versioned table of a name; drawers are keyed by id and sorted by wing."""
        order = ["wing", "id"] if schema is DRAWER_SCHEMA else key
        return VersionedTable(self.spark, f"{self.folder}/{name}", schema, key or ["id"], order)

    def exists(self, collection: str) -> bool:
        return self.table(collection).exists()

    def ensure(self, collection: str) -> None:
        if not self.exists(collection):
            self.table(collection).commit(self.spark.createDataFrame([], DRAWER_SCHEMA))

    def read(self, collection: str) -> DataFrame:
        """The stored drawers, in schema order; a missing collection is empty."""
        return self.table(collection).read()

    def add(self, collection: str, drawers: DataFrame) -> None:
        """Append the drawers whose id is not stored yet."""
        self.table(collection).commit(mutations.new_drawers(self.read(collection), drawers))

    def replace(self, collection: str, drawers: DataFrame) -> None:
        self.table(collection).replace(drawers)

    def delete(self, collection: str, ids: DataFrame) -> None:
        """Remove drawers; one tombstone per id is written."""
        self.table(collection).commit(gone=ids.select("id"))

    def delete_sources(self, collection: str, sources: DataFrame) -> None:
        """Remove the drawers of sources; one tombstone per drawer is written."""
        keys = sources.select(F.lower("source_file").alias("_key")).distinct()
        stored = self.read(collection).select("id", F.lower("source_file").alias("_key"))
        self.table(collection).commit(gone=stored.join(keys, "_key", "left_semi").select("id"))

    def upsert(self, collection: str, drawers: DataFrame) -> None:
        """Insert or replace drawers."""
        self.table(collection).commit(drawers, gone=drawers.select("id"))

    def repair(self, collection: str) -> None:
        """Fold all changes into files with the drawers of a wing in id order."""
        self.ensure(collection)
        self.table(collection).compact()


def read_json_collection(spark: SparkSession, path: str) -> DataFrame:
    """Drawers of exported collection documents, without the report of ``json_collections.read_collections``."""
    return read_collections(spark, path).where("status = 'read'").select(*DRAWER_SCHEMA.names)
