import json
import random

from pyspark.sql import functions as F

from tidemark.functions.payload import sorted_map, vector_json
from tidemark.functions.timegrain import (
    arrival,
    arrival_of,
    arrival_rank,
    arrived_before,
    coarse_grain,
    rank_after,
    window_start,
)


def test_coarse_grain_truncates_toward_zero(spark):
    rows = spark.createDataFrame([(7,), (-7,), (-2000,), (12345,)], "ms bigint")
    got = {r.ms: r.b for r in rows.select("ms", coarse_grain(F.col("ms"), F.lit(5)).alias("b")).collect()}
    assert got == {7: 5, -7: -5, -2000: -2000, 12345: 12345}
    assert spark.range(1).select(coarse_grain(F.lit(-2000), F.lit(5000))).first()[0] == 0


def test_window_start_floors_like_window(spark):
    rows = spark.createDataFrame([(-2_000_000,), (12_345_678,), (0,), (-1,)], "us bigint")
    both = rows.select(
        window_start(F.col("us"), F.lit(5000)).alias("mine"),
        F.unix_millis(F.window(F.timestamp_micros("us"), "5 seconds").start).alias("theirs"),
    ).collect()
    assert all(r.mine == r.theirs for r in both)


def test_rank_keeps_order_and_round_trips(spark):
    rng = random.Random(3)
    big = 2**63 - 1
    times = [0, 1, -1, 1_700_000_000_000_000, -1_700_000_000_000_000]
    ties = [0, 1, -1, big, -big]
    pairs = [(t, k) for t in times for k in ties]
    rng.shuffle(pairs)
    rows = spark.createDataFrame(pairs, "t bigint, k bigint").select(
        "t", "k", arrival(F.col("t"), F.col("k")).alias("a")
    )
    ranked = rows.select(
        "t", "k", arrival_rank(F.col("a")).alias("r"), arrival_of(arrival_rank(F.col("a"))).alias("back"),
        rank_after(F.col("t")).alias("after"),
    ).collect()
    assert all((r.back.us, r.back.tie) == (r.t, r.k) for r in ranked)
    assert [(r.t, r.k) for r in sorted(ranked, key=lambda r: r.r)] == sorted(pairs)
    assert all((r.after > other.r) == (other.t <= r.t) for r in ranked for other in ranked)
    pair = rows.alias("x").crossJoin(rows.alias("y")).select(
        (arrived_before(F.col("x.a"), F.col("y.a")) == (F.col("x.a") < F.col("y.a"))).alias("same")
    )
    assert pair.where(~F.col("same")).count() == 0


def test_vector_json_keeps_nulls_in_name_order(spark):
    entries = F.array(
        F.struct(F.lit("f2").alias("k"), F.lit(None).cast("double").alias("v")),
        F.struct(F.lit("f1").alias("k"), F.lit(1.5).alias("v")),
    )
    text = spark.range(1).select(vector_json(F.timestamp_millis(F.lit(5000)), sorted_map(entries))).first()[0]
    assert text == '{"bucket":"1970-01-01T00:00:05.000Z","values":{"f1":1.5,"f2":null}}'
    assert json.loads(text)["values"]["f2"] is None


def test_times_do_not_depend_on_the_zone_of_the_session(spark):
    """Messages are written and read, and the table's times taken, as UTC."""
    from tidemark.catalog import batch, feeds
    from tidemark.schemas import READING
    from tidemark.sources.messages import parse

    folder = "/root/testdata/sf0.001"

    def seen():
        one = spark.range(1).select(
            vector_json(F.timestamp_millis(F.lit(5000)), F.create_map(F.lit("f1"), F.lit(1.0))).alias("json")
        ).head()[0]
        text = spark.createDataFrame([('{"timestamp": "1970-01-01T00:00:08"}',)], "json_value string")
        read = parse(text, READING).select(F.unix_seconds("timestamp")).head()[0]
        events = feeds.timed(feeds.events(spark, folder)).select(F.sum(F.unix_micros("timestamp").cast("decimal(38,0)"))).head()[0]
        emitted = sorted(map(tuple, batch.QUERIES["t2_closed_buckets"](spark, folder).collect()))
        return one, read, events, emitted

    utc = seen()
    assert utc[0] == '{"bucket":"1970-01-01T00:00:05.000Z","values":{"f1":1.0}}' and utc[1] == 8
    for zone in ("Asia/Kolkata", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert seen() == utc
            assert spark.conf.get("spark.sql.session.timeZone") == zone
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
