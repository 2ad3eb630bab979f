"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Retention of 360 batches is one hour at the 10 s trigger.
STREAM_SETTINGS = {
    "spark.sql.streaming.metricsEnabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "360",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

CHECKPOINT_DIR = "spark.checkpoint.dir"

_SCOPE: ContextVar[str | None] = ContextVar("tidemark_job_scope", default=None)


def build_session(app_name: str = "tidemark", master: str | None = None, **settings: str) -> SparkSession:
    """Create a session with UTC time, adaptive execution and the stream settings.

    Keyword names use ``_`` for ``.``: ``spark_sql_shuffle_partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **STREAM_SETTINGS,
    }
    for name, value in defaults.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def use_stream_settings(spark: SparkSession) -> None:
    """Apply the stream settings to a session somebody else created."""
    for name, value in STREAM_SETTINGS.items():
        spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets a
    temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application and, in one, by job scope."""
    return f"{_SCOPE.get() or _application_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def job_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made within the block belong to it and are deleted at its end.

    Frames built within the block must be used up (written, collected) there too.
    """
    folder = scratch_path(spark, "job")
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back.

    Used for the (small) per-bucket tables that several later steps read: the
    input is scanned once, the later steps get exact size statistics, and a
    lost executor does not force the first pass to be run again.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, those of running jobs included."""
    _delete(spark, _application_dir(spark))
