"""Queries run as streams over the whole table present now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import feeds
from tidemark.catalog.batch import damaged, rounded
from tidemark.session import use_stream_settings
from tidemark.operators.enrich import REJECT, enrich_keyed, tag_vectors, unfit
from tidemark.sources.files import stream_table
from tidemark.sources.messages import person_readings
from tidemark.streaming.jobs import chained, fused, idle_vector_stream, keyed_stream, keyed_stream_with_late_rows, spread, vector_stream
from tidemark.streaming.progress import ProgressLog, observe_emitted, observe_rejects
from tidemark.streaming.run import run_bounded, start_all, start_bounded, to_parquet, writer
from tidemark.streaming.side_output import late_schema, read_batches, write_both
from tidemark.streaming.state import open_buckets
from tidemark.streaming.watermark import windowed, windowed_union
from tidemark.session import scratch_path


def _events(spark: SparkSession, folder: str) -> DataFrame:
    use_stream_settings(spark)
    return stream_table(spark, folder, "events")


def _people_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Readings without late ones: a built-in watermark drops those by micro-batch."""
    readings = person_readings(feeds.person_columns(_events(spark, folder), late=False))
    return enrich_keyed(readings, feeds.people_settings(spark))


def key_watermarks(spark: SparkSession, folder: str) -> DataFrame:
    """One watermarked query per key, all running at once."""
    rows = _people_rows(spark, folder)
    outs, paths = [], []
    for key, setting in feeds.WINDOWS.items():
        base = scratch_path(spark, f"windows-{key}")
        out = writer(windowed(rows, key, *setting), f"windows-{key}", f"{base}/checkpoint", "bounded")
        outs.append(to_parquet(out, f"{base}/out"))
        paths.append(f"{base}/out")
    for query in start_all(outs):
        query.awaitTermination()
    schema = windowed(rows, "m", *feeds.WINDOWS["m"]).schema
    return spark.read.schema(schema).parquet(*paths).select("key", "bucket_ms", rounded())


def union_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """All keys in one query under one watermark."""
    out = windowed_union(_people_rows(spark, folder), feeds.WINDOWS)
    return run_bounded(out, "windows-union").select("key", "bucket_ms", rounded())


def _numbered(spark: SparkSession, folder: str, form) -> DataFrame:
    readings = person_readings(feeds.person_columns(_events(spark, folder)))
    out = keyed_stream(readings, feeds.people_settings(spark), timers=False, form=form)
    return run_bounded(out, "keyed").select("key", "bucket_ms", "bucket_index", rounded())


def numbered_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(spark, folder, form=fused)


def numbered_spread(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(spark, folder, form=spread)


def _vectors(spark: SparkSession, folder: str, form, **options) -> DataFrame:
    readings = feeds.device_readings(_events(spark, folder))
    out = vector_stream(readings, feeds.vector_settings(spark), timers=False, form=form, **options)
    cells = run_bounded(out, "vectors").select(
        F.col("key").alias("vector"), "bucket_ms", "bucket_index", F.explode("filled")
    )
    return cells.select(
        "vector",
        "bucket_ms",
        "bucket_index",
        F.col("key").alias("feature"),
        F.round("value", 6).alias("filled"),
    )


def fused_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, form=fused)


def chained_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, form=chained)


def spread_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, form=spread)


def member_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets that member features opened only."""
    return _vectors(spark, folder, form=fused, only_member_buckets=True).drop("bucket_index")


def member_spread(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, form=spread, only_member_buckets=True).drop("bucket_index")


def late_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Late rows per vector and bucket. The stream itself reports an increment per micro-batch."""
    readings = feeds.device_readings(_events(spark, folder))
    out = vector_stream(readings, feeds.vector_settings(spark), timers=False, report_late=True)
    late = run_bounded(out, "late").where(F.col("emit_reason") == "late")
    return late.groupBy(F.col("key").alias("vector"), "bucket_ms").agg(F.sum("n_late").alias("n_late"))


def timeout_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Timeouts on the clock of arrivals."""
    readings = feeds.device_readings(_events(spark, folder))
    out = idle_vector_stream(readings, feeds.idle_vector_settings(spark), feeds.VECTOR_CLOCK)
    cells = run_bounded(out, "timeouts").select("*", F.explode("filled").alias("feature", "known"))
    return cells.select(
        F.col("key").alias("vector"), "epoch", "bucket_ms", "bucket_index", "feature", F.round("known", 6).alias("filled"), "emit_reason"
    )


def late_rows_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Late readings as rows, written beside the emitted buckets by the same stateful pass."""
    readings = person_readings(feeds.person_columns(_events(spark, folder)))
    both = keyed_stream_with_late_rows(readings, feeds.people_settings(spark), timers=False)
    base = scratch_path(spark, "late-rows")
    write_both(both, "late-rows", f"{base}/checkpoint", f"{base}/emitted", f"{base}/late", "bounded").awaitTermination()
    late = read_batches(spark, late_schema(both), f"{base}/late")
    return late.select("key", F.col("tie").alias("event_id"), "bucket_ms", "value")


def open_buckets_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets still open after all input, from the stream's own state."""
    readings = feeds.device_readings(_events(spark, folder))
    out = vector_stream(readings, feeds.vector_settings(spark), timers=False)
    base = scratch_path(spark, "open-buckets")
    start_bounded(out, "open-buckets", base).awaitTermination()
    return open_buckets(spark, f"{base}/checkpoint").select(F.col("key").alias("vector"), "bucket_ms")


def progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of rejected, late and emitted rows as two running streams have reported them."""
    settings = feeds.vector_settings(spark)
    tagged = observe_rejects(tag_vectors(damaged(_events(spark, folder)), settings))
    emitted = vector_stream(feeds.device_readings(_events(spark, folder)), settings, timers=False, report_late=True)
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        frames = {"rejects": unfit(tagged).select("offset", REJECT), "vectors": observe_emitted(emitted)}
        runs = [start_bounded(frame, name, scratch_path(spark, name)) for name, frame in frames.items()]
        for query in runs:
            query.awaitTermination()
            log.wait(query.runId)
    finally:
        spark.streams.removeListener(log)
    found = log.table(spark).groupBy("query", "metric").agg(F.sum("value").alias("n"))
    return found.where("n > 0 AND NOT (query = 'vectors' AND metric = 'rows_read')")


QUERIES = {
    "w1_key_watermarks_stream": key_watermarks,
    "u1_union_stream": union_watermark,
    "t4_timeout_stream": timeout_stream,
    "t7_numbered_stream": numbered_stream,
    "t7_spread_stream": numbered_spread,
    "t8_vectors_stream": fused_vectors,
    "t8_members_stream": member_vectors,
    "t8_members_spread_stream": member_spread,
    "t8_spread_stream": spread_vectors,
    "t12_chained_stream": chained_vectors,
    "o3_open_buckets_stream": open_buckets_stream,
    "s13_progress_stream": progress_stream,
    "t11_late_stream": late_stream,
    "t11_late_rows_stream": late_rows_stream,
}
