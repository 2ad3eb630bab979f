"""The ``events`` table as readings.

Devices and features follow the shape of the original message generator. Events
come in order and are delivered in that order; lateness is made by moving the event
time of every 17th reading back by eight hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import KeySettings, VectorSettings
from tidemark.functions.timegrain import arrival
from tidemark.operators.epochs import IdleClock
from tidemark.sources.files import read_table

# One unit of the original settings (a second) becomes 12 minutes.
SCALE = 720

# key -> step, delay, latest; the people settings at the scale of the table.
WINDOWS = {
    "m": (5000 * SCALE, 20_000 * SCALE, True),
    "f": (10_000 * SCALE, 30_000 * SCALE, False),
}

LATE_US = 8 * 3600 * 1_000_000


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events")


def utc_us(ts: str) -> Column:
    """Microseconds of a time without zone, read as UTC whatever the session's zone."""
    seconds = F.expr(
        f"unix_date(CAST({ts} AS DATE)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60"
    )
    return seconds * 1_000_000 + F.expr(f"CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")


def timed(frame: DataFrame, late: bool = True) -> DataFrame:
    """Adds ``timestamp`` (event time) and ``arrival``; without ``late`` no event time is moved."""
    us = utc_us("ts")
    happened = F.when(F.col("event_id") % 17 == 0, us - LATE_US).otherwise(us) if late else us
    return frame.withColumn("timestamp", F.timestamp_micros(happened)).withColumn(
        "arrival", arrival(us, F.col("event_id"))
    )


def device() -> Column:
    return F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string"))


def feature() -> Column:
    slot = F.col("user_id") % 3
    return (
        F.when(slot == 0, "f1")
        .when(slot == 1, "f2")
        .when(F.col("event_type").isin("click", "view", "error"), "f3")
        .otherwise("f4")
    )


def device_readings(frame: DataFrame) -> DataFrame:
    """``name, device, value, timestamp, arrival``."""
    return timed(frame).select(
        feature().alias("name"), device().alias("device"), "value", "timestamp", "arrival"
    )


def person_columns(frame: DataFrame, late: bool = True) -> DataFrame:
    """``name, sex, age, timestamp, arrival``."""
    return timed(frame, late).select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("user_id") % 2 == 0, "m").otherwise("f").alias("sex"),
        F.floor("value").cast("int").alias("age"),
        "timestamp",
        "arrival",
    )


def user_readings(frame: DataFrame) -> DataFrame:
    """``key, value, timestamp, arrival`` with one key per user."""
    return timed(frame).select(F.col("user_id").alias("key"), "value", "timestamp", "arrival")


def vector_settings(spark: SparkSession) -> VectorSettings:
    return VectorSettings.from_maps(spark, scale=SCALE)


# Pauses at the scale of the table: vectors time out after a quarter of an hour.
VECTOR_TIMEOUT_MS = 15 * 60 * 1000
VECTOR_CLOCK = IdleClock(cleanup_ms=3600 * 1000, delay_ms=1000)
USER_CLOCK = IdleClock(cleanup_ms=24 * 3600 * 1000, delay_ms=1000)


def idle_vector_settings(spark: SparkSession) -> VectorSettings:
    return VectorSettings.from_maps(spark, scale=SCALE, timeout_ms=VECTOR_TIMEOUT_MS)


def people_settings(spark: SparkSession) -> KeySettings:
    return KeySettings.from_maps(spark, scale=SCALE)


def user_settings(frame: DataFrame) -> KeySettings:
    """Settings for every user: even users as ``m``, odd ones as ``f``."""
    users = frame.select(F.col("user_id").alias("key")).distinct()
    even = F.col("key") % 2 == 0
    return KeySettings.from_frame(
        users.select(
            "key",
            F.when(even, 5000 * SCALE).otherwise(10000 * SCALE).alias("step_ms"),
            F.when(even, "latest").otherwise("average").alias("agg"),
            F.when(even, 20 * SCALE).otherwise(30 * SCALE).alias("watermark_s"),
        )
    )
