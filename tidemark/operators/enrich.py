"""From parsed readings to bucketed rows, with a reason for every rejected one.

Rows that pass have the columns the later operators share:

``key``           group with its own lateness allowance (person key or vector)
``feature``       name of the measured feature (vector job only)
``bucket_ms``     coarse-grained event time
``ts_us``         event time
``value``         double
``arrival``       struct giving the total arrival order
``is_member``     whether the feature belongs to the vector
``latest``        aggregation: latest value, else average
``step_ms``, ``watermark_ms``, ``timeout_ms``  settings of the row's key
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import KeySettings, VectorSettings
from tidemark.functions.timegrain import coarse_grain, event_ms, event_us
from tidemark.operators.lookup import lookup_join

REJECT = "reject_reason"

# All reasons, in no order that matters.
REASONS = (
    "bad_json", "no_arrival", "null_field", "non_finite", "unknown_key", "unknown_device", "unknown_feature",
)


def _first_reason(*cases: tuple[Column, str]) -> Column:
    """Name of the first condition that holds, else null."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in cases])


def _unfit(value: Column, *required: Column) -> list[tuple[Column, str]]:
    missing = value.isNull()
    for column in required:
        missing = missing | column.isNull()
    endless = F.isnan(value) | F.abs(value).isin(float("inf"))
    return [(missing, "null_field"), (endless, "non_finite")]


def _parse_reason(readings: DataFrame) -> list[tuple[Column, str]]:
    """What messages can suffer before their fields count."""
    lost = [(F.col("arrival").isNull(), "no_arrival")] if "arrival" in readings.columns else []
    if "bad_json" in readings.columns:
        return [(F.col("bad_json"), "bad_json"), *lost]
    return lost


def bucket_columns() -> list[Column]:
    return [
        coarse_grain(event_ms(F.col("timestamp")), F.col("step_ms")).alias("bucket_ms"),
        event_us(F.col("timestamp")).alias("ts_us"),
    ]


def tag_keyed(readings: DataFrame, settings: KeySettings) -> DataFrame:
    """Look up the settings of every ``(key, value, timestamp, arrival)`` reading.

    Adds ``reject_reason``; the lookup is a left join so that rejected readings
    stay visible. :func:`fit` turns it back into an inner join.
    """
    joined = lookup_join(readings, settings.keys, ["key"], "left")
    value = F.col("value").cast("double")
    reason = _first_reason(
        *_parse_reason(readings),
        *_unfit(value, F.col("key"), F.col("timestamp")),
        (F.col("step_ms").isNull(), "unknown_key"),
    )
    return joined.withColumn("value", value).withColumn(REJECT, reason)


def enrich_keyed(readings: DataFrame, settings: KeySettings) -> DataFrame:
    """Bucketed rows of one-value jobs; unfit readings are left out."""
    return fit(tag_keyed(readings, settings), "step_ms").select(
        "key",
        *bucket_columns(),
        "value",
        "arrival",
        F.lit(True).alias("is_member"),
        "latest",
        "step_ms",
        "watermark_ms",
        "timeout_ms",
    )


def tag_vectors(readings: DataFrame, settings: VectorSettings) -> DataFrame:
    """Fan every ``(name, device, value, timestamp, arrival)`` reading out to its vectors.

    One row per vector of the device, with the feature's step and whether the
    feature belongs to the vector. A reading of a foreign feature stays: it opens
    a bucket of the vector without advancing the vector's newest bucket.
    """
    routed = lookup_join(readings, settings.fan_out, ["device"], "left")
    stepped = lookup_join(
        routed.withColumnRenamed("name", "feature"), settings.features, ["feature"], "left"
    )
    reason = _first_reason(
        *_parse_reason(readings),
        *_unfit(F.col("value"), F.col("feature"), F.col("device"), F.col("timestamp")),
        (F.col("vector").isNull(), "unknown_device"),
        (F.col("step_ms").isNull(), "unknown_feature"),
    )
    return stepped.withColumn(REJECT, reason)


def enrich_vectors(readings: DataFrame, settings: VectorSettings) -> DataFrame:
    """Bucketed rows of the vector job; unfit readings are left out."""
    rows = fit(tag_vectors(readings, settings), "vector", "step_ms")
    members = settings.members.frame.select("vector", "feature", F.lit(True).alias("_member"))
    marked = lookup_join(
        rows, type(settings.members)(members, settings.members.size), ["vector", "feature"], "left"
    )
    return marked.select(
        F.col("vector").alias("key"),
        "feature",
        *bucket_columns(),
        "value",
        "arrival",
        F.col("_member").isNotNull().alias("is_member"),
        "latest",
        "step_ms",
        "watermark_ms",
        "timeout_ms",
    )


def fit(tagged: DataFrame, *looked_up: str) -> DataFrame:
    """Readings without a reject reason.

    The looked-up columns are tested directly as well, so that Catalyst sees the
    null test and replaces the left joins by inner ones.
    """
    known = F.col(REJECT).isNull()
    for name in looked_up:
        known = known & F.col(name).isNotNull()
    return tagged.where(known).drop(REJECT)


def unfit(tagged: DataFrame) -> DataFrame:
    """Rejected readings with their reason."""
    return tagged.where(F.col(REJECT).isNotNull())


def drop_incomplete(rows: DataFrame) -> DataFrame:
    """Rows without any null."""
    return rows.na.drop()


def only_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one key."""
    return rows.where(F.col("key") == F.lit(key))
