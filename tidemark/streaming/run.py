"""Sinks, triggers and running several queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.session import scratch_path

TRIGGER = "10 seconds"


def writer(
    frame: DataFrame, name: str, checkpoint: str, trigger: str | None = TRIGGER
) -> DataStreamWriter:
    """Named append-mode writer with its own checkpoint.

    ``trigger=None`` runs batches as fast as possible; ``"bounded"`` ends once the
    input present at the start has been read.
    """
    out = (
        frame.writeStream.outputMode("append").queryName(name).option("checkpointLocation", checkpoint)
    )
    if trigger == "bounded":
        return out.trigger(availableNow=True)
    return out.trigger(processingTime=trigger) if trigger else out


def to_console(out: DataStreamWriter) -> DataStreamWriter:
    return out.format("console").option("truncate", False)


def to_parquet(out: DataStreamWriter, path: str, *partition_by: str) -> DataStreamWriter:
    shaped = out.format("parquet").option("path", path)
    return shaped.partitionBy(*partition_by) if partition_by else shaped


def start_bounded(frame: DataFrame, name: str, base: str) -> StreamingQuery:
    """Start a stream over the input present now, with its checkpoint and output below ``base``."""
    return to_parquet(writer(frame, name, f"{base}/checkpoint", "bounded"), f"{base}/out").start()


def run_bounded(frame: DataFrame, name: str) -> DataFrame:
    """Run a stream over the input present now and return what it wrote."""
    spark = frame.sparkSession
    base = scratch_path(spark, name)
    start_bounded(frame, name, base).awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/out")


def start_all(writers: list[DataStreamWriter]) -> list[StreamingQuery]:
    return [out.start() for out in writers]


def await_any(spark: SparkSession) -> None:
    """Wait until one of the session's queries ends."""
    spark.streams.awaitAnyTermination()


@contextmanager
def no_empty_batches(spark: SparkSession) -> Iterator[None]:
    """Start queries that run no batches without data.

    A bounded query with processing-time timers never ends otherwise.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
