import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.replay import device_frame, key_frame, random_readings, replay_vectors
from tidemark.config import KeySettings, VectorSettings
from tidemark.operators import lateness
from tidemark.operators.enrich import enrich_vectors
from tidemark.operators.lateness import closing_points, judge, late_report
from tidemark.plans.keyed import KeyedJob, inactive_buckets, window_buckets
from tidemark.plans.vectors import VectorJob


@pytest.fixture(scope="module")
def people(spark):
    return KeySettings.from_maps(spark)


@pytest.fixture(scope="module")
def vectors(spark):
    return VectorSettings.from_maps(spark)


def emitted(frame):
    return sorted((r.key, r.bucket_ms // 1000, r.value) for r in frame.collect())


def late_ids(job, readings):
    return sorted(r.i for r in job.judged(readings).where("not accepted").select(F.col("arrival.tie").alias("i")).collect())


def cells(frame):
    return sorted(
        ((r.key, r.bucket_ms, r.feature, r.value, r.filled) for r in frame.collect()), key=repr
    )


def expected_cells(readings, flush=False):
    rows, _ = replay_vectors(readings, flush)
    return sorted(((v, b, f, value, filled) for v, b, _, f, value, filled in rows), key=repr)


def test_late_inside_one_batch(spark, people):
    assert late_ids(KeyedJob(people), key_frame(spark, [("m", 1, 100), ("m", 2, 10)])) == [1]


def test_boundary_is_late(spark, people):
    rows = key_frame(spark, [("m", 1, 100), ("m", 2, 80), ("m", 3, 85)])
    assert late_ids(KeyedJob(people), rows) == [1]


def test_keys_do_not_share_lateness(spark, people):
    rows = key_frame(spark, [("m", 1, 100), ("f", 2, 80), ("f", 3, 75)])
    assert late_ids(KeyedJob(people), rows) == []


def test_close_and_flush(spark, people):
    rows = key_frame(spark, [("m", 1, 100), ("m", 2, 120)])
    assert emitted(KeyedJob(people).buckets(rows)) == [("m", 100, 1.0)]
    flushed = KeyedJob(people, flush=True).buckets(rows)
    assert sorted((r.bucket_ms, r.emit_reason) for r in flushed.collect()) == [
        (100_000, "closed"), (120_000, "timeout"),
    ]


def test_aggregation_comes_from_settings(spark, people):
    rows = key_frame(spark, [("m", 1, 100), ("m", 3, 101), ("f", 1, 100), ("f", 4, 101)])
    assert emitted(KeyedJob(people, flush=True).buckets(rows)) == [("f", 100, 2.5), ("m", 100, 3.0)]


def test_three_tie_rules(spark, people):
    rows = key_frame(spark, [("m", 5, 100), ("m", 9, 100), ("m", 7, 100)])
    assert emitted(KeyedJob(people, flush=True).buckets(rows)) == [("m", 100, 5.0)]
    assert emitted(inactive_buckets(rows, people)) == [("m", 100, 7.0)]
    assert emitted(window_buckets(rows, people, closed_only=False)) == [("m", 100, 9.0)]


def test_window_closes_at_its_end(spark, people):
    rows = [("m", 1, 100), ("m", 2, 124.999)]
    assert emitted(window_buckets(key_frame(spark, rows), people)) == []
    assert emitted(window_buckets(key_frame(spark, [*rows, ("m", 3, 125)]), people)) == [("m", 100, 1.0)]


def test_numbering_restarts_per_key(spark, people):
    rows = key_frame(spark, [(k, 1, s) for s in (100, 110, 140, 200) for k in ("m", "f")])
    for size in (1, 65_536):
        got = KeyedJob(people, segment_buckets=size).numbered(rows).collect()
        assert sorted((r.key, r.bucket_ms // 1000, r.bucket_index) for r in got) == [
            ("f", 100, 0), ("f", 110, 1), ("f", 140, 2), ("m", 100, 0), ("m", 110, 1), ("m", 140, 2),
        ]


def test_before_1970(spark, people):
    rows = key_frame(spark, [("m", 1, -2), ("m", 2, -19), ("m", 3, -25)])
    assert late_ids(KeyedJob(people), rows) == [2]
    assert emitted(KeyedJob(people, flush=True).buckets(rows)) == [("m", -15, 2.0), ("m", 0, 1.0)]


def test_foreign_feature_opens_without_advancing(spark, vectors):
    readings = [("f3", "d2", 1.0, 5_000_000), ("f3", "d2", 2.0, 90_000_000), ("f3", "d2", 3.0, 6_000_000)]
    frame = device_frame(spark, readings)
    assert cells(VectorJob(vectors).filled(frame)) == [("v2", 5000, "f3", 1.0, 1.0)]
    flushed = cells(VectorJob(vectors, flush=True).filled(frame))
    assert [c for c in flushed if c[0] == "v3"] == [("v3", 5000, "f4", None, None), ("v3", 90000, "f4", None, None)]
    only = cells(VectorJob(vectors, flush=True, only_member_buckets=True).filled(frame))
    assert [c for c in only if c[0] == "v3"] == []


def test_mixed_steps_fill_and_never_seen(spark, vectors):
    frame = device_frame(spark, [("f1", "d0", 1.0, 5_000_000), ("f2", "d1", 2.0, 12_000_000)])
    assert cells(VectorJob(vectors, flush=True).filled(frame)) == [
        ("v1", 10000, "f1", None, 1.0), ("v1", 10000, "f2", 2.0, 2.0),
        ("v1", 5000, "f1", 1.0, 1.0), ("v1", 5000, "f2", None, None),
    ]


def test_empty_input(spark, vectors, people):
    assert VectorJob(vectors).filled(device_frame(spark, [("f1", "d9", 1.0, 0)])).count() == 0
    assert KeyedJob(people).numbered(key_frame(spark, [("x", 1, 1)])).count() == 0


@pytest.mark.parametrize("flush", [False, True])
@pytest.mark.parametrize("segment_buckets", [1, 3, 65_536])
def test_matches_replay(spark, vectors, flush, segment_buckets):
    readings = random_readings(random.Random(segment_buckets), 500)
    job = VectorJob(vectors, flush=flush, segment_buckets=segment_buckets)
    frame = device_frame(spark, readings)
    assert cells(job.filled(frame)) == expected_cells(readings, flush)
    _, late = replay_vectors(readings)
    report = {r.key: r.n_late for r in late_report(job.judged(frame)).collect()}
    assert report == late and sum(late.values()) > 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), start=st.sampled_from([-40, 0, 5_000]), spread=st.integers(1, 120))
def test_matches_replay_for_any_arrival_order(spark, vectors, seed, start, spread):
    readings = random_readings(random.Random(seed), 80, spread, start)
    job = VectorJob(vectors, flush=True, segment_buckets=4)
    assert cells(job.filled(device_frame(spark, readings))) == expected_cells(readings, True)


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_shuffled_judgement_equals_broadcast(spark, vectors, hot_rows, monkeypatch):
    monkeypatch.setattr(lateness, "HOT_ROWS", hot_rows)
    rows = enrich_vectors(device_frame(spark, random_readings(random.Random(5), 400)), vectors)
    closings = closing_points(rows)

    def flags(judged):
        return sorted((r.key, r.t, r.accepted) for r in judged.select("key", F.col("arrival.tie").alias("t"), "accepted").collect())

    shuffled = judge(rows, closings, broadcast_bytes=0)
    assert flags(shuffled) == flags(judge(rows, closings))


def test_long_time_span_keeps_segments_bounded(spark, people):
    day = 86_400
    readings = [("m", i, i * day) for i in range(300)]
    frame = key_frame(spark, readings)
    job = KeyedJob(people, segment_buckets=1000)
    assert emitted(job.buckets(frame)) == sorted(("m", i * day, float(i)) for i in range(299))
    assert job.numbered(frame).agg(F.max("bucket_index")).first()[0] == 298
