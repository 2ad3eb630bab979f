"""Jobs on the built-in watermark: one windowed aggregate per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregate import latest_larger
from tidemark.operators.enrich import only_key


def windowed(readings: DataFrame, key: str, step_ms: int, watermark_ms: int, latest: bool) -> DataFrame:
    """``(key, bucket_ms, value)`` of one key's closed windows.

    ``readings`` has ``key, bucket_ms, ts_us, value``. Takes a stream or a table.
    """
    timed = (
        only_key(readings, key)
        .withColumn("ts", F.timestamp_micros("ts_us"))
        .withWatermark("ts", f"{watermark_ms} milliseconds")
    )
    value = latest_larger() if latest else F.avg("value")
    return (
        timed.groupBy(F.window("ts", f"{step_ms} milliseconds"), "bucket_ms")
        .agg(value.alias("value"))
        .select(F.lit(key).alias("key"), "bucket_ms", "value")
    )


def windowed_union(readings: DataFrame, settings: dict[str, tuple[int, int, bool]]) -> DataFrame:
    """All keys in one query.

    Such a query has one watermark, that of the key furthest behind; it closes
    the windows of every key.
    """
    return reduce(
        DataFrame.unionByName,
        [windowed(readings, key, *setting) for key, setting in sorted(settings.items())],
    )
