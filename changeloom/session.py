"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows carry whole diffs, so Arrow batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # JSON with a repeated key keeps the last value, as most JSON readers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Checkpoints of tables that are no longer used are deleted.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def with_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    return builder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="changeloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


# Rows in an Arrow batch at most.
BATCH_ROWS = 512


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per Spark application, and keep their batches short.

    The driver may have it on its own path only.  Spark copies the archive to every executor, also to later ones.  Rows carry
    whole texts, so a session that allows longer Arrow batches gets ``BATCH_ROWS``; workers live on between stages, and what the
    largest batch took counts against an executor's memory until the end.
    """
    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if getattr(context, "_changeloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="changeloom-package-")) / "changeloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._changeloom_shipped = True


@contextmanager
def batches_by_bytes(spark: SparkSession, rows: int = 8192, size: int = 1 << 20) -> Iterator[None]:
    """For steps run at once, Arrow batches of up to ``rows`` rows and ``size`` bytes: rows of a few numbers travel in fewer
    batches, and long texts in shorter ones.  The session's own settings come back."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {key: spark.conf.get(key) for key in limits}
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Actions of DataFrames that are made inside delete the files of their shuffles when they end.

    Otherwise the files stay until the driver's garbage happens to be collected, so that what all steps of a query have shuffled may
    lie on the disks at once.  The session's own setting comes back.
    """
    before = spark.conf.get(RELEASE, None)
    try:
        spark.conf.set(RELEASE, "true")
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so that a lost executor cannot lose the result.  The files of the shuffles that
    have led to it go."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        # The setting counts when a plan is made, so the rows get one of their own.
        return df.select("*").checkpoint(eager=True)
