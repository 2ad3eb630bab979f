"""Late readings of a stream as rows, beside the emitted buckets.

One stateful pass gives both. Each micro-batch is kept on disk while its two parts are written,
so the pass is not repeated, and each part replaces what an earlier try of the same batch has
left: a query that stops between the two writes and starts again gives every row once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.streaming.processors import CLEANUP_MS, NUMBERED_ROWS, FusedProcessor, _mode, _numbered_frame
from tidemark.streaming.run import TRIGGER, writer
from tidemark.streaming.stages import ARRIVAL, STAGED, InArrivalOrder

LATE = "late"
READING = ["feature", "ts_us", "value", *ARRIVAL]
ROWS = f"{NUMBERED_ROWS}, feature string, ts_us bigint, value double, arrival_us bigint, tie bigint"


def _whole(frame: pd.DataFrame) -> pd.DataFrame:
    """An emitted frame with the columns of a reading, all null."""
    for name, kind in zip(READING, ("object", "Int64", "Float64", "Int64", "Int64")):
        frame[name] = pd.array([None] * len(frame), dtype=kind)
    return frame


class LateRowsProcessor(FusedProcessor):
    """The fused form; each late reading is a row with reason ``late`` and its own columns."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = InArrivalOrder(rows, [*STAGED, *ARRIVAL])
        closed = False
        for arrays in batch.chunks():
            emitted, _, late = self.buckets.take(arrays, batch.watermark, batch.layout)
            if emitted:
                closed = True
                yield _whole(_numbered_frame(key[0], emitted, self.carry, "closed"))
            if late.any():
                n = int(late.sum())
                yield pd.DataFrame(
                    {
                        "key": key[0],
                        "bucket_ms": arrays["bucket_ms"][late],
                        "bucket_index": pd.array([None] * n, dtype="Int32"),
                        "values": [None] * n,
                        "filled": [None] * n,
                        "emit_reason": LATE,
                        "n_late": pd.array([1] * n, dtype="Int64"),
                        **{name: arrays[name][late] for name in READING},
                    }
                )
        self._rearm(timerValues, batch.timeout, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for frame in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield _whole(frame)


def with_late_rows(rows: DataFrame, timers: bool = True, cleanup_ms: int = CLEANUP_MS) -> DataFrame:
    return rows.groupBy("key").transformWithStateInPandas(
        LateRowsProcessor(timers, True, cleanup_ms), ROWS, "append", _mode(timers)
    )


def emitted_part(both: DataFrame) -> DataFrame:
    return both.where(F.col("emit_reason") != LATE).drop("n_late", *READING)


def late_part(both: DataFrame) -> DataFrame:
    return both.where(F.col("emit_reason") == LATE).select("key", "bucket_ms", *READING)


def emitted_schema(both: DataFrame) -> StructType:
    return emitted_part(both).schema


def late_schema(both: DataFrame) -> StructType:
    return late_part(both).schema


def put_batch(part: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch's part, in place of an earlier try."""
    part.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_both(
    both: DataFrame, name: str, checkpoint: str, emitted_path: str, late_path: str, trigger: str | None = TRIGGER
) -> StreamingQuery:
    """Start a query that writes emitted buckets and late readings to a folder each."""

    def put(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            put_batch(emitted_part(kept), emitted_path, batch_id)
            put_batch(late_part(kept), late_path, batch_id)
        finally:
            kept.unpersist()

    return writer(both, name, checkpoint, trigger).foreachBatch(put).start()


def read_batches(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """What :func:`write_both` has written to one of its folders."""
    return spark.read.schema(schema).parquet(path)
