"""Queries over tables, one per operator. Every query reads the whole ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.catalog import feeds
from tidemark.config import split_list
from tidemark.functions.timegrain import coarse_grain, event_ms, event_us
from tidemark.operators.aggregate import by_setting, latest_first, latest_last, mean
from tidemark.operators.diagnostics import order_breaks
from tidemark.operators.enrich import (
    REJECT,
    drop_incomplete,
    enrich_keyed,
    enrich_vectors,
    only_key,
    tag_vectors,
    unfit,
)
from tidemark.operators.lateness import closing_points, judge, late_report, late_rows
from tidemark.plans.idle import IdleKeyedJob, IdleVectorJob
from tidemark.plans.keyed import KeyedJob, inactive_buckets, window_buckets
from tidemark.plans.vectors import VectorJob
from tidemark.schemas import PERSON, READING
from tidemark.sources.messages import decode, parse, person_readings, with_arrival
from tidemark.streaming.watermark import windowed


def rounded(name: str = "value") -> Column:
    return F.round(name, 6).alias(name)


# --- parsing


def records(frame: DataFrame) -> DataFrame:
    """Kafka-shaped records of device readings."""
    message = F.to_json(
        F.struct("name", "device", "value", "timestamp"),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"},
    )
    timed = feeds.timed(frame)
    return timed.select(
        "event_id",
        "value",
        "timestamp",
        feeds.feature().alias("name"),
        feeds.device().alias("device"),
        F.timestamp_micros(F.col("arrival.us")).alias("broker_time"),
    ).select(
        F.encode("device", "utf-8").alias("key"),
        F.encode(message, "utf-8").alias("value"),
        F.col("broker_time").alias("timestamp"),
        (F.col("event_id") % 8).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )


def decoded_text(spark: SparkSession, folder: str) -> DataFrame:
    raw = feeds.events(spark, folder).select(
        "event_id",
        F.encode("event_type", "utf-8").alias("key"),
        F.encode("props", "utf-8").alias("value"),
    )
    return decode(raw).select("event_id", "key", "json_value")


def broker_time(spark: SparkSession, folder: str) -> DataFrame:
    ordered = with_arrival(decode(records(feeds.events(spark, folder))))
    return ordered.select(
        F.col("offset").alias("event_id"),
        F.col("arrival.us").alias("arrival_us"),
        F.col("arrival.tie").alias("tie"),
    )


def parsed_props(spark: SparkSession, folder: str) -> DataFrame:
    text = feeds.events(spark, folder).select("event_id", F.col("props").alias("json_value"))
    return parse(text, StructType.fromDDL("k INT"), "event_id").select("event_id", "k")


def parsed_readings(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse(decode(records(feeds.events(spark, folder))), READING, "offset")
    return parsed.select(
        F.col("offset").alias("event_id"),
        "name",
        "device",
        "value",
        event_us(F.col("timestamp")).alias("ts_us"),
        "bad_json",
    )


def parsed_people(spark: SparkSession, folder: str) -> DataFrame:
    people = feeds.person_columns(feeds.events(spark, folder))
    text = people.select(
        F.col("arrival.tie").alias("event_id"),
        F.to_json(
            F.struct("name", "sex", "age", F.unix_seconds("timestamp").alias("timestamp"))
        ).alias("json_value"),
    )
    typed = person_readings(parse(text, PERSON, "event_id"))
    return typed.select("event_id", "key", "value", event_ms(F.col("timestamp")).alias("ts_ms"))


def damaged(frame: DataFrame) -> DataFrame:
    """Parsed messages of events, damaged in four ways, with their ``event_id`` as ``offset``."""
    n = F.col("offset")
    text = F.col("json_value")
    spoilt = (
        F.when(n % 13 == 0, F.lit("garbage"))
        .when(n % 19 == 0, F.regexp_replace(text, '"device":"d[0-9]"', '"device":"d9"'))
        .when(n % 23 == 0, F.regexp_replace(text, '"name":"f[0-9]"', '"name":"f9"'))
        .when(n % 29 == 0, F.regexp_replace(text, '"value":[^,]*,', ""))
        .otherwise(text)
    )
    whole = with_arrival(decode(records(frame)))
    return parse(whole.withColumn("json_value", spoilt), READING, "offset", "arrival")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Messages damaged in four ways; each is reported with its reason."""
    tagged = tag_vectors(damaged(feeds.events(spark, folder)), feeds.vector_settings(spark))
    return unfit(tagged).select(F.col("offset").alias("event_id"), REJECT)


# --- projections, filters, enrichment


def renamed(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.device_readings(feeds.events(spark, folder)).select(
        F.col("arrival.tie").alias("event_id"), F.col("name").alias("feature"), "device", "value"
    )


def struct_access(spark: SparkSession, folder: str) -> DataFrame:
    packed = feeds.events(spark, folder).select(
        "event_id", F.struct(F.col("event_type"), F.col("value").alias("amount")).alias("s")
    )
    return packed.select("event_id", F.col("s.event_type").alias("kind"), F.col("s.amount").alias("amount"))


def cast_age(spark: SparkSession, folder: str) -> DataFrame:
    people = feeds.person_columns(feeds.events(spark, folder))
    return people.select(F.col("arrival.tie").alias("event_id"), F.col("age").cast("double").alias("age"))


def _people_rows(spark: SparkSession, folder: str) -> DataFrame:
    people = feeds.person_columns(feeds.events(spark, folder))
    return enrich_keyed(person_readings(people), feeds.people_settings(spark))


def key_settings(spark: SparkSession, folder: str) -> DataFrame:
    return _people_rows(spark, folder).select(
        F.col("arrival.tie").alias("event_id"), "key", "step_ms", "latest", "watermark_ms"
    )


def coarse_grained(spark: SparkSession, folder: str) -> DataFrame:
    """Event times moved back 54 years, so that about half lie before 1970."""
    frame = feeds.timed(feeds.events(spark, folder))
    ms = event_ms(F.col("timestamp")) - F.lit(1_705_500_000_000)
    step = F.when(F.col("user_id") % 2 == 0, 5000).otherwise(10000).cast("bigint")
    return frame.select("event_id", ms.alias("ts_ms"), coarse_grain(ms, step).alias("bucket_ms"))


def one_key(spark: SparkSession, folder: str) -> DataFrame:
    return only_key(_people_rows(spark, folder), "m").select(
        F.col("arrival.tie").alias("event_id"), "key", "value"
    )


def _vector_rows(spark: SparkSession, folder: str) -> DataFrame:
    readings = feeds.device_readings(feeds.events(spark, folder))
    return enrich_vectors(readings, feeds.vector_settings(spark))


def fanned_out(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_rows(spark, folder).select(
        F.col("arrival.tie").alias("event_id"), F.col("key").alias("vector"), "feature", "bucket_ms"
    )


def comma_list(spark: SparkSession, folder: str) -> DataFrame:
    """Fan-out with the vectors given as a comma list on every reading."""
    listed = feeds.device_readings(feeds.events(spark, folder)).select(
        F.col("arrival.tie").alias("event_id"),
        F.when(F.col("device") == "d2", "v2,v3").otherwise("v1").alias("vector"),
    )
    return split_list(listed, "vector")


def membership(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_rows(spark, folder).select(
        F.col("arrival.tie").alias("event_id"), F.col("key").alias("vector"), "feature", "is_member"
    )


def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    gaps = feeds.events(spark, folder).select(
        "event_id",
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )
    return drop_incomplete(gaps)


# --- aggregates


def _tied_rows(spark: SparkSession, folder: str) -> DataFrame:
    people = feeds.person_columns(feeds.events(spark, folder))
    cut = people.withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    return enrich_keyed(person_readings(cut), feeds.people_settings(spark))


def _windowed(rows: DataFrame, key: str) -> DataFrame:
    """All windows of one key; over a table the watermark has no effect."""
    return windowed(rows, key, *feeds.WINDOWS[key]).select("bucket_ms", rounded())


def window_average(spark: SparkSession, folder: str) -> DataFrame:
    return _windowed(_people_rows(spark, folder), "f")


def window_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _windowed(_tied_rows(spark, folder), "m")


def first_arrival_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _tied_rows(spark, folder).groupBy("key", "bucket_ms").agg(latest_first().alias("value"))


def last_arrival_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _tied_rows(spark, folder).groupBy("key", "bucket_ms").agg(latest_last().alias("value"))


def bucket_mean(spark: SparkSession, folder: str) -> DataFrame:
    means = _people_rows(spark, folder).groupBy("key", "bucket_ms").agg(mean().alias("value"))
    return means.select("key", "bucket_ms", rounded())


def mean_or_latest(spark: SparkSession, folder: str) -> DataFrame:
    return by_setting(_tied_rows(spark, folder), ["key", "bucket_ms"]).select(
        "key", "bucket_ms", rounded(), "n_rows"
    )


def assembled(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_job(spark).assembled(_readings(spark, folder)).select(
        F.col("key").alias("vector"), "bucket_ms", "feature", rounded()
    )


def grouping_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_rows(spark, folder).groupBy("key").agg(
        F.count("*").alias("n_rows"), F.count_distinct("bucket_ms").alias("n_buckets")
    )


# --- keyed and vector jobs


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.device_readings(feeds.events(spark, folder))


def _people(spark: SparkSession, folder: str) -> DataFrame:
    return person_readings(feeds.person_columns(feeds.events(spark, folder)))


def _vector_job(spark: SparkSession, **options) -> VectorJob:
    return VectorJob(feeds.vector_settings(spark), **options)


def _keyed_job(spark: SparkSession, **options) -> KeyedJob:
    return KeyedJob(feeds.people_settings(spark), **options)


def key_windows(spark: SparkSession, folder: str) -> DataFrame:
    people = person_readings(feeds.person_columns(feeds.events(spark, folder), late=False))
    return window_buckets(people, feeds.people_settings(spark)).select(
        "key", "bucket_ms", rounded()
    )


def late_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_job(spark).judged(_readings(spark, folder)).select(
        F.col("key").alias("vector"), F.col("arrival.tie").alias("event_id"), "bucket_ms", "accepted"
    )


def closed_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed_job(spark).buckets(_people(spark, folder)).select(
        "key", "bucket_ms", rounded(), "emit_reason"
    )


def flushed_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed_job(spark, flush=True).buckets(_people(spark, folder)).select(
        "key", "bucket_ms", rounded(), "emit_reason"
    )


def quiet_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return inactive_buckets(_people(spark, folder), feeds.people_settings(spark)).select(
        "key", "bucket_ms", rounded()
    )


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed_job(spark).numbered(_people(spark, folder))


def filled(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_job(spark).filled(_readings(spark, folder)).select(
        F.col("key").alias("vector"), "bucket_ms", "feature", rounded("filled")
    )


def filled_all(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_job(spark, flush=True).filled(_readings(spark, folder)).select(
        F.col("key").alias("vector"), "bucket_ms", "feature", rounded("filled"), "emit_reason"
    )


def members_only(spark: SparkSession, folder: str) -> DataFrame:
    job = _vector_job(spark, only_member_buckets=True)
    return job.filled(_readings(spark, folder)).select(
        F.col("key").alias("vector"), "bucket_ms", "feature", rounded("filled")
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as text messages; readings are cut to whole numbers so that sums are exact."""
    whole = _readings(spark, folder).withColumn("value", F.floor("value").cast("double"))
    return _vector_job(spark).messages(whole)


def arrival_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vector_rows(spark, folder).select("key", "arrival", "ts_us")
    return order_breaks(rows, ["arrival.us", "arrival.tie"], "ts_us", "n_unsorted")


def value_order(spark: SparkSession, folder: str) -> DataFrame:
    return order_breaks(
        _vector_rows(spark, folder), ["arrival.us", "arrival.tie"], "value", "n_falling"
    )


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vector_rows(spark, folder)
    return late_report(judge(rows, closing_points(rows))).withColumnRenamed("key", "vector")


def late_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _people_rows(spark, folder)
    return late_rows(judge(rows, closing_points(rows))).select(
        "key", F.col("arrival.tie").alias("event_id"), "bucket_ms", "value"
    )


def open_buckets(spark: SparkSession, folder: str) -> DataFrame:
    closings = closing_points(_vector_rows(spark, folder))
    still_open = closings.frame.where(F.col("opened") & F.col("closes_at").isNull())
    return still_open.select(F.col("key").alias("vector"), "bucket_ms")


def many_keys(spark: SparkSession, folder: str) -> DataFrame:
    """One key per user, settings taken from the table itself."""
    frame = feeds.events(spark, folder)
    job = KeyedJob(feeds.user_settings(frame))
    return job.buckets(feeds.user_readings(frame)).select("key", "bucket_ms", rounded(), "emit_reason")


def timeout_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """One key per user, with pauses longer than a key's timeout; a bucket can come more than once."""
    frame = feeds.events(spark, folder)
    job = IdleKeyedJob(feeds.user_settings(frame), feeds.USER_CLOCK)
    return job.numbered(feeds.user_readings(frame)).select(
        "key", "epoch", "bucket_ms", "bucket_index", rounded(), "emit_reason", "emitted_ms"
    )


def restarted(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors whose numbering and known values start anew after a pause of the output."""
    job = IdleVectorJob(feeds.idle_vector_settings(spark), feeds.VECTOR_CLOCK)
    return job.filled(_readings(spark, folder)).select(
        F.col("key").alias("vector"), "epoch", "bucket_ms", "bucket_index", "feature", rounded("filled"), "emit_reason"
    )


QUERIES = {
    "s2_decode": decoded_text,
    "s3_broker_time": broker_time,
    "s4_json_parse": parsed_props,
    "s5_flatten": parsed_readings,
    "s6_typed_people": parsed_people,
    "q1_rejected": rejected,
    "p1_rename": renamed,
    "p2_struct": struct_access,
    "p3_cast": cast_age,
    "p4_key_settings": key_settings,
    "p5_coarse_grain": coarse_grained,
    "p8_fan_out": fanned_out,
    "p8_comma_list": comma_list,
    "p9_one_key": one_key,
    "p10_membership": membership,
    "p11_na_drop": complete_rows,
    "p12_messages": messages,
    "a1_window_average": window_average,
    "a2_window_latest": window_latest,
    "a3_latest_first_arrival": first_arrival_latest,
    "a4_latest_last_arrival": last_arrival_latest,
    "a5_mean": bucket_mean,
    "a6_mean_or_latest": mean_or_latest,
    "a7_assembled": assembled,
    "a8_grouping_keys": grouping_keys,
    "w2_key_windows": key_windows,
    "t1_late_filter": late_filter,
    "t2_closed_buckets": closed_buckets,
    "t2_many_keys": many_keys,
    "t4_flushed_buckets": flushed_buckets,
    "t4_timeout_buckets": timeout_buckets,
    "t6_quiet_buckets": quiet_buckets,
    "t7_numbered": numbered,
    "t8_filled": filled,
    "t8_filled_all": filled_all,
    "t8_members_only": members_only,
    "t9_restarted": restarted,
    "t10_arrival_order": arrival_order,
    "t10_value_order": value_order,
    "t11_late_counts": late_counts,
    "t11_late_rows": late_table,
    "o3_open_buckets": open_buckets,
}
