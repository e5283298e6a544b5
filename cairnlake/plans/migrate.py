"""Migration of a drawer table: staged as a version of its own, checked, then switched to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import is_blank
from cairnlake.operators.taxonomy import migration_summary
from cairnlake.session import cut_lineage
from cairnlake.sources.versions import VersionedTable


class MigrationError(RuntimeError):
    """The staged drawers are not those that were to be migrated; the table is unchanged."""


@dataclass(frozen=True)
class MigrationReport:
    """``version`` and ``backup`` are 0 where nothing was written; ``backup`` is the version before."""

    drawers: int
    imported: int
    version: int
    backup: int
    summary: DataFrame


def importable(drawers: DataFrame) -> DataFrame:
    """One drawer per id, the one with the smallest text, as an import adds an id only once."""
    struct = F.struct("text", *[F.col(c) for c in drawers.columns if c not in ("id", "text")])
    return drawers.groupBy("id").agg(F.min(struct).alias("_row")).select("id", "_row.*")


def figures(drawers: DataFrame) -> tuple[int, int]:
    """Number of drawers and sum of the hashes of ids and texts, which does not depend on their order."""
    row = drawers.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")), F.lit(0)).alias("sum")
    ).first()
    return row["n"], int(row["sum"])


def migrate(table: VersionedTable, drawers: DataFrame, dry_run: bool = False) -> MigrationReport:
    """Make ``drawers`` the content of ``table``.

    A dry run, or a source without drawers, gives the summary and writes nothing. Else the
    drawers are written beside the table and read back: number and hashes must agree, and
    no id or text may be missing. Only then is the version switched; the one before stays
    as the backup that ``table.rollback`` brings back. A run that fails before the switch
    leaves the table as it was.
    """
    found = cut_lineage(drawers)
    summary, count = migration_summary(found), found.count()
    if dry_run or not count:
        return MigrationReport(count, 0, 0, 0, summary)
    wanted = cut_lineage(importable(found))
    backup = table.manifest().version
    staged = table.stage(wanted, afresh=True)
    written = table.read(staged)
    if figures(written) != figures(wanted):
        raise MigrationError("the staged drawers differ from the source")
    if not written.where(F.col("id").isNull() | is_blank(F.col("text"))).isEmpty():
        raise MigrationError("a staged drawer has no id or no text")
    table.switch(staged)
    return MigrationReport(count, figures(written)[0], staged.version, backup, summary)
