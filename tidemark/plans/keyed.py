"""One-value jobs: keys with their own bucket width, aggregation and lateness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import KeySettings
from tidemark.functions.timegrain import window_start
from tidemark.operators.aggregate import by_setting, latest_larger, latest_last
from tidemark.operators.enrich import enrich_keyed
from tidemark.operators.lateness import (
    Closings,
    accepted_rows,
    closing_points,
    emitted_buckets,
    judge,
)
from tidemark.operators.scan import SEGMENT_BUCKETS
from tidemark.operators.vectors import number_buckets
from tidemark.session import materialise


@dataclass(frozen=True)
class KeyedJob:
    """Per-key watermark job over a finite table of readings.

    Gives the rows the streaming job gives for the same arrivals, however these
    are cut into batches. ``flush`` also emits what is still open at the end.
    """

    settings: KeySettings
    flush: bool = False
    segment_buckets: int = SEGMENT_BUCKETS

    def _closings(self, readings: DataFrame) -> tuple[DataFrame, Closings]:
        rows = enrich_keyed(readings, self.settings)
        return rows, closing_points(rows, segment_buckets=self.segment_buckets)

    def judged(self, readings: DataFrame) -> DataFrame:
        """Every row with its ``accepted`` flag."""
        rows, closings = self._closings(readings)
        return judge(rows, closings)

    def buckets(self, readings: DataFrame) -> DataFrame:
        """``(key, bucket_ms, value, emit_reason)`` of the emitted buckets."""
        rows, closings = self._closings(readings)
        values = by_setting(accepted_rows(judge(rows, closings)), ["key", "bucket_ms"])
        emitted = emitted_buckets(closings, self.flush)
        return emitted.join(values, ["key", "bucket_ms"]).select(
            "key", "bucket_ms", "value", "emit_reason"
        )

    def numbered(self, readings: DataFrame) -> DataFrame:
        """``(key, bucket_ms, bucket_index)``; needs no values, so one pass is enough."""
        _, closings = self._closings(readings)
        emitted = emitted_buckets(closings, self.flush).select("key", "bucket_ms")
        return number_buckets(emitted, closings.segments)


def inactive_buckets(readings: DataFrame, settings: KeySettings) -> DataFrame:
    """Every (key, bucket) by itself, nothing dropped as late; last arrival wins ties."""
    rows = enrich_keyed(readings, settings)
    return by_setting(rows, ["key", "bucket_ms"], latest_last).select("key", "bucket_ms", "value").na.drop()


def window_buckets(readings: DataFrame, settings: KeySettings, closed_only: bool = True) -> DataFrame:
    """Tumbling windows of key-specific width, grouped by window and bucket.

    ``closed_only`` keeps what a watermarked query has emitted once all rows are
    in: windows ending at or before the key's newest event time less its delay.
    """
    rows = enrich_keyed(readings, settings).withColumn(
        "window_ms", window_start(F.col("ts_us"), F.col("step_ms"))
    )
    end_us = (F.col("window_ms") + F.col("step_ms")) * F.lit(1000)
    windows = (
        rows.groupBy("key", "window_ms", "bucket_ms", "step_ms", "watermark_ms")
        .agg(
            F.coalesce(
                latest_larger(F.col("latest")),
                F.avg(F.when(~F.col("latest"), F.col("value"))),
            ).alias("value"),
            F.max("ts_us").alias("newest_us"),
        )
    )
    if closed_only:
        # Read twice below; keep to one pass over the readings.
        windows = materialise(windows, "windows")
        newest = windows.groupBy("key").agg(F.max("newest_us").alias("key_newest_us"))
        # The watermark has millisecond precision.
        mark_ms = F.call_function("div", F.col("key_newest_us"), F.lit(1000)) - F.col("watermark_ms")
        windows = windows.join(newest, "key").where(end_us <= mark_ms * F.lit(1000))
    return windows.select("key", "bucket_ms", "value")
