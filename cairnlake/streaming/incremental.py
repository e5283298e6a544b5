"""Keep a collection in step with a streamed folder of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairnlake.plans.ingest import RunCounts, pending_files
from cairnlake.session import cut_lineage
from cairnlake.sources.store import Collections

Miner = Callable[[DataFrame], DataFrame]
Report = Callable[[int, dict[str, int]], None]
IDLE = {"files": 0, "processed": 0, "skipped": 0, "drawers": 0}


def follow(
    files: DataFrame,
    store: Collections,
    collection: str,
    mine: Miner,
    checkpoint: str,
    by_time: bool = True,
    report: Report | None = None,
) -> StreamingQuery:
    """Start a query that mines every micro batch of ``(path, source_file, source_mtime, content)`` rows.

    A batch writes its new drawers and the tombstones of stale ones. A batch replayed after
    a failure finds finished files current and does the others again. ``report`` gets the
    number of each finished batch and its totals over new and stale files, observed while
    they were mined.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.ensure(collection)
        stored, counts, totals = store.read(collection), RunCounts(), IDLE
        pending = cut_lineage(counts.files(pending_files(stored, batch, by_time)))
        if not pending.isEmpty():
            mined = cut_lineage(counts.drawers(mine(pending)))
            store.delete_sources(collection, pending.where("state = 'stale'"))
            store.add(collection, mined)
            totals = counts.totals()
        if report:
            report(number, dict(totals))

    return (
        files.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
