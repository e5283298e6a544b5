"""Session factory and the checkpoint helper used to cut iterative plans."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def create_session(app_name: str = "cairnlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; extra ``conf`` wins.

    Partition counts are left to adaptive execution: on a cluster start from a
    high ``spark.sql.shuffle.partitions`` and let it coalesce.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local master may fall back to a private one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="cairnlake-checkpoint-")
    context.setCheckpointDir(configured)


def shared_folder(spark: SparkSession) -> str:
    """Folder under the checkpoint folder for tables that a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Persist ``df`` in the reliable checkpoint folder so later rounds do not replay its plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_free(df: DataFrame) -> DataFrame:
    """``cut_lineage`` whose shuffle files go as soon as the checkpoint is written."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN_UP)
    conf.set(CLEAN_UP, "true")
    try:
        # The setting is read where a query is made, so the frame is made anew.
        return cut_lineage(df.select("*"))
    finally:
        conf.set(CLEAN_UP, before)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished steps now instead of at its next periodic collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
