"""Streaming jobs from parsed readings to emitted buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import KeySettings, Lookup, VectorSettings
from tidemark.operators.enrich import enrich_keyed, enrich_vectors
from tidemark.operators.epochs import IdleClock
from tidemark.operators.lookup import lookup_join
from tidemark.operators.vectors import to_messages
from tidemark.streaming.arrival_clock import arrival_clock
from tidemark.streaming.processors import CLEANUP_MS, chained, fused, inactive
from tidemark.streaming.side_output import with_late_rows
from tidemark.streaming.spread import spread

__all__ = [
    "chained", "fused", "spread", "inactive_stream", "keyed_stream", "vector_stream", "idle_keyed_stream", "idle_vector_stream",
]

VALUE = "value"


def _flat(rows: DataFrame) -> DataFrame:
    """Arrival order as two numbers; columns no processor reads are dropped."""
    return rows.select(
        "*", F.col("arrival.us").alias("arrival_us"), F.col("arrival.tie").alias("tie")
    ).drop("arrival", "step_ms", "latest")


def keyed_stream_rows(readings: DataFrame, settings: KeySettings) -> DataFrame:
    rows = enrich_keyed(readings, settings)
    layout = F.concat(F.lit(f"{VALUE}="), F.col("latest").cast("string"))
    return _flat(
        rows.withColumn("key", F.col("key").cast("string"))
        .withColumn("feature", F.lit(VALUE))
        .withColumn("layout", layout)
    )


def vector_stream_rows(readings: DataFrame, settings: VectorSettings) -> DataFrame:
    entry = F.concat_ws("=", "feature", F.col("latest").cast("string"))
    layouts = settings.members.frame.groupBy(F.col("vector").alias("key")).agg(
        F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("layout")
    )
    rows = enrich_vectors(readings, settings)
    return _flat(lookup_join(rows, Lookup(layouts, settings.members.size), ["key"]))


def _run(
    form: Callable[..., DataFrame],
    rows: DataFrame,
    timers: bool,
    report_late: bool,
    salts: int | None,
    initial: DataFrame | None = None,
) -> DataFrame:
    if initial is not None:
        if form is not fused:
            raise ValueError("only the fused form takes over the state of another query")
        return fused(rows, timers, report_late, initial=initial)
    if form is not spread:
        return form(rows, timers, report_late)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread(rows, timers, report_late, salts=salts or max(2, partitions))


def keyed_stream(
    readings: DataFrame,
    settings: KeySettings,
    timers: bool = True,
    report_late: bool = False,
    form: Callable[..., DataFrame] = fused,
    salts: int | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """``(key, bucket_ms, bucket_index, value, emit_reason, n_late)``; forms and ``initial`` as below."""
    out = _run(form, keyed_stream_rows(readings, settings), timers, report_late, salts, initial)
    return out.select(
        "key",
        "bucket_ms",
        "bucket_index",
        F.col("values")[VALUE].alias("value"),
        "emit_reason",
        "n_late",
    )


def vector_stream(
    readings: DataFrame,
    settings: VectorSettings,
    timers: bool = True,
    report_late: bool = False,
    form: Callable[..., DataFrame] = fused,
    salts: int | None = None,
    only_member_buckets: bool = False,
    initial: DataFrame | None = None,
) -> DataFrame:
    """``(key, bucket_ms, bucket_index, values, filled, emit_reason, n_late)``.

    ``form`` is :func:`fused`, :func:`chained` or, for very busy keys, :func:`spread`,
    which works on a key in ``salts`` tasks (default: as many as shuffle partitions).
    With ``only_member_buckets`` foreign features open no buckets, and are not reported
    as late. ``initial`` takes over the state of a query that had other settings
    (:func:`tidemark.streaming.state.carried`); fused form only.
    """
    rows = vector_stream_rows(readings, settings)
    rows = rows.where("is_member") if only_member_buckets else rows
    return _run(form, rows, timers, report_late, salts, initial)


def idle_keyed_stream(
    readings: DataFrame, settings: KeySettings, clock: IdleClock, report_late: bool = False
) -> DataFrame:
    """``keyed_stream`` with timeouts on the clock of arrivals, and ``epoch`` and ``emitted_ms``."""
    out = arrival_clock(keyed_stream_rows(readings, settings), clock, report_late)
    return out.withColumn("value", F.col("values")[VALUE]).drop("values", "filled")


def idle_vector_stream(
    readings: DataFrame,
    settings: VectorSettings,
    clock: IdleClock,
    report_late: bool = False,
    only_member_buckets: bool = False,
) -> DataFrame:
    """``vector_stream`` with timeouts on the clock of arrivals, and ``epoch`` and ``emitted_ms``."""
    rows = vector_stream_rows(readings, settings)
    return arrival_clock(rows.where("is_member") if only_member_buckets else rows, clock, report_late)


def keyed_stream_with_late_rows(
    readings: DataFrame, settings: KeySettings, timers: bool = True, cleanup_ms: int = CLEANUP_MS
) -> DataFrame:
    """Emitted buckets and late readings of the one-value job in one stream; see ``write_both``."""
    return with_late_rows(keyed_stream_rows(readings, settings), timers, cleanup_ms)


def vector_stream_with_late_rows(
    readings: DataFrame, settings: VectorSettings, timers: bool = True, cleanup_ms: int = CLEANUP_MS
) -> DataFrame:
    """Emitted buckets and late readings of the vector job in one stream; see ``write_both``."""
    return with_late_rows(vector_stream_rows(readings, settings), timers, cleanup_ms)


def vector_messages(emitted: DataFrame) -> DataFrame:
    """``(key, value)`` text messages of the emitted vectors."""
    return to_messages(
        emitted.where(F.col("emit_reason") != "late").select(
            "key", "bucket_ms", F.col("filled").alias("values")
        )
    )


def inactive_stream(readings: DataFrame, settings: KeySettings) -> DataFrame:
    """One state per (key, bucket), emitted after the key's timeout without rows."""
    rows = enrich_keyed(readings, settings).withColumn("key", F.col("key").cast("string"))
    return inactive(
        rows.withColumn("arrival_us", F.col("arrival.us")).withColumn("tie", F.col("arrival.tie"))
    )
