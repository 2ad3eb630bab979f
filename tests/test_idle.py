import os
import random
import weakref
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tests.replay import (
    LAYOUTS,
    ROUTES,
    STEPS,
    WATERMARKS,
    Replay,
    idle_frame,
    idle_readings,
    key_frame,
    random_readings,
    replay_idle,
    replay_vectors,
    shaped_idle,
    truncated,
)
from tidemark.config import KeySettings, VectorSettings
from tidemark.functions.timegrain import arrival
from tidemark.operators import lateness
from tidemark.operators.epochs import IdleClock, by_epoch, find_epochs
from tidemark.plans.idle import IdleKeyedJob, IdleVectorJob
from tidemark.plans.keyed import KeyedJob
from tidemark.sources.files import stream_folder
from tidemark.streaming import side_output, stages
from tidemark.streaming.jobs import chained, idle_vector_stream, vector_stream, vector_stream_with_late_rows
from tidemark.streaming.progress import ProgressLog
from tidemark.streaming.run import run_bounded, start_bounded, to_parquet, writer
from tidemark.streaming.stages import PAGES, BucketStage
from tidemark.streaming.state import carried, key_progress, open_buckets, open_cells

TIMEOUT, CLEANUP = 5000, 9000


def cells(frame):
    names = ["key", "epoch", "bucket_ms", "bucket_index", "feature", "value", "filled", "emit_reason", "emitted_ms"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("segment_buckets", [65_536, 1])
def test_against_replay(spark, seed, segment_buckets):
    rng = random.Random(seed)
    readings = idle_readings(rng, 160)
    flush, delay, members = seed % 2 == 0, rng.choice([0, 1, 4000]), seed % 3 == 2
    settings = VectorSettings.from_maps(spark, timeout_ms=TIMEOUT)
    job = IdleVectorJob(settings, IdleClock(CLEANUP, delay), flush, members, segment_buckets)
    found = cells(job.filled(idle_frame(spark, readings).repartition(3)))
    want = sorted(replay_idle(readings, TIMEOUT, CLEANUP, flush, delay, members), key=repr)
    assert found == want
    assert {r[7] for r in want} == {"closed", "timeout"}


def test_epochs_are_cut_where_the_pause_exceeds_the_timeout(spark):
    """By definition, from one window per key."""
    rng = random.Random(1)
    rows, now = [], 0
    for i in range(4000):
        now += rng.choice([0, 1, 10, 4_999, 5_000, 5_001, 60_000])
        rows.append((rng.choice("abc"), now * 1000 + rng.randrange(1000), i))
    frame = spark.createDataFrame(rows, "key string, us bigint, tie bigint").select(
        "key", arrival(F.col("us"), F.col("tie")).alias("arrival"), F.lit(5000).cast("bigint").alias("timeout_ms")
    )
    for segment_buckets in (65_536, 3):
        epochs = find_epochs(frame, IdleClock(), segment_buckets)
        assert (epochs.segments.count > 1) == (segment_buckets == 3)
        got = {(r.key, r.slot): r.epoch for r in epochs.slots.frame.collect()}
        last, number = {}, {}
        for key, us, _ in sorted(rows, key=lambda r: r[1:]):
            ms = us // 1000
            number[key] = number.get(key, 0) + (key in last and ms - last[key] > 5000)
            last[key] = ms
            assert got[key, ms // 5000] == number[key]
        ended = {(r.key, r.epoch) for r in epochs.ends.where("ended").collect()}
        newest = max(last.values())
        assert ended == {(k, e) for k in number for e in range(number[k] + (last[k] + 5000 < newest))}


def timed_keys(spark, rows):
    """``(key, value, event s, arrival s)``."""
    raw = [(k, float(v), int(s * 1e6), int(a * 1e6), i) for i, (k, v, s, a) in enumerate(rows)]
    frame = spark.createDataFrame(raw, "key string, value double, ts bigint, at bigint, seq bigint")
    return frame.select(
        "key", "value", F.timestamp_micros("ts").alias("timestamp"), arrival(F.col("at"), F.col("seq")).alias("arrival")
    )


def test_bucket_comes_again_after_a_timeout(spark):
    # The timeout of m is its watermark, 20 s.
    rows = timed_keys(spark, [("m", 1, 100, 0), ("m", 2, 101, 20), ("m", 3, 100, 41), ("f", 0, 0, 100)])
    job = IdleKeyedJob(KeySettings.from_maps(spark))
    found = sorted((r.epoch, r.bucket_ms, r.value, r.emit_reason, r.emitted_ms) for r in job.buckets(rows).collect())
    # Arrivals 20 s apart are one epoch, 21 s apart are two; f is open still.
    assert found == [(0, 100_000, 2.0, "timeout", 40_000), (1, 100_000, 3.0, "timeout", 61_000)]


def test_old_readings_are_accepted_after_a_timeout(spark):
    rows = timed_keys(spark, [("m", 1, 100, 0), ("m", 2, 10, 1), ("m", 3, 10, 30), ("m", 4, 100, 31)])
    found = IdleKeyedJob(KeySettings.from_maps(spark), flush=True).buckets(rows)
    got = sorted((r.epoch, r.bucket_ms, r.value, r.emit_reason) for r in found.collect())
    assert got == [(0, 100_000, 1.0, "timeout"), (1, 10_000, 3.0, "closed"), (1, 100_000, 4.0, "timeout")]


def test_numbering_starts_anew_after_a_pause_of_the_output(spark):
    rows = timed_keys(spark, [("m", i, 100 + 30 * i, 25 * i) for i in range(4)] + [("m", 9, 500, 5000), ("f", 0, 0, 9999)])
    job = IdleKeyedJob(KeySettings.from_maps(spark), IdleClock(cleanup_ms=60_000))
    found = sorted((r.run, r.bucket_index, r.bucket_ms, r.epoch) for r in job.numbered(rows).collect())
    assert found == [(0, i, 100_000 + 30_000 * i, i) for i in range(4)] + [(1, 0, 500_000, 4)]


def test_without_pauses_it_is_the_plain_job(spark):
    rng = random.Random(3)
    rows = key_frame(spark, [(rng.choice("mf"), rng.randrange(50), i + rng.randrange(40)) for i in range(300)])
    settings = KeySettings.from_maps(spark)
    plain = sorted(tuple(r) for r in KeyedJob(settings, flush=True).buckets(rows).select("key", "bucket_ms", "value", "emit_reason").collect())
    idle = IdleKeyedJob(settings, flush=True).buckets(rows)
    assert sorted(tuple(r) for r in idle.select("key", "bucket_ms", "value", "emit_reason").collect()) == plain


def test_empty_table(spark):
    rows = timed_keys(spark, [("m", 1, 1, 1)]).where("false")
    assert IdleKeyedJob(KeySettings.from_maps(spark)).numbered(rows).count() == 0


def idle_stream(spark, folder, readings, slices):
    """A folder with one file per micro-batch; rows within a file are not in order."""
    size = -(-len(readings) // slices)
    schema = pa.schema([("name", pa.string()), ("device", pa.string()), ("value", pa.float64()), ("ts_us", pa.int64()), ("at_us", pa.int64()), ("seq", pa.int64())])
    numbered = [(*r, i) for i, r in enumerate(readings)]
    for k, at in enumerate(range(0, len(readings), size)):
        part = numbered[at : at + size]
        random.Random(k).shuffle(part)
        path = f"{folder}/part{k}.parquet"
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema), path)
        os.utime(path, (1_700_000_000 + k,) * 2)
    ddl = StructType.fromDDL("name string, device string, value double, ts_us bigint, at_us bigint, seq bigint")
    return shaped_idle(stream_folder(spark, str(folder), ddl, files_per_trigger=1))


def streamed(frame):
    out = frame.where("emit_reason <> 'late'").collect()
    return sorted(
        ((r.key, r.epoch, r.bucket_ms, r.bucket_index, f, r["values"][f], v, r.emit_reason, r.emitted_ms) for r in out for f, v in r.filled.items()),
        key=repr,
    )


@pytest.mark.parametrize("slices, delay, members", [(1, 1, False), (4, 1000, False), (40, 1, True)])
def test_stream_equals_replay_for_any_slicing(spark, tmp_path, slices, delay, members):
    readings = idle_readings(random.Random(slices), 160)
    clock = IdleClock(CLEANUP, delay)
    settings = VectorSettings.from_maps(spark, timeout_ms=TIMEOUT)
    out = idle_vector_stream(idle_stream(spark, tmp_path, readings, slices), settings, clock, only_member_buckets=members)
    want = replay_idle(readings, TIMEOUT, CLEANUP, False, delay, members)
    assert streamed(run_bounded(out, "idle")) == sorted(want, key=repr)


def test_stream_needs_a_delay(spark, tmp_path):
    rows = idle_stream(spark, tmp_path, idle_readings(random.Random(0), 5), 1)
    with pytest.raises(ValueError):
        idle_vector_stream(rows, VectorSettings.from_maps(spark), IdleClock())


class Handle:
    """State in memory, with the calls that the stages make."""

    class Value:
        def __init__(self):
            self.value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Map(dict):
        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

        def iterator(self):
            return iter(self.items())

    def getValueState(self, name, schema):
        return self.Value()

    def getMapState(self, name, key, value):
        return self.Map()


def arrays(buckets, feature="a"):
    n = len(buckets)
    return {
        "bucket_ms": np.array(buckets, np.int64), "feature": np.array([feature] * n), "ts_us": np.array(buckets, np.int64) * 1000,
        "value": np.arange(n, dtype=float), "is_member": np.ones(n, bool),
    }


def test_reads_follow_touched_and_closed_buckets():
    """One key with 100,000 open buckets: a batch reads as few pages as with a hundred."""
    reads = {}
    for n in (100, 100_000):
        stage = BucketStage(Handle())
        allowance = n * 1000
        stage.take(arrays([1000 * i for i in range(1, n)]), allowance, "a=false")
        stage.open.reads = 0
        emitted, closers, late = stage.take(arrays([1000 * n, 1000 * (n + 1)]), allowance, "a=false")
        assert [b for b, _ in emitted] == [1000] and closers.tolist() == [1] and not late.any()
        reads[n] = stage.open.reads
        assert len(stage.open.map) <= PAGES + 2
        rest = [b for b, _ in stage.flush()]
        assert rest == [1000 * i for i in range(2, n + 2)]
    assert reads[100_000] <= reads[100] + 1 and reads[100_000] <= 4


@pytest.mark.parametrize("seed", range(5))
def test_pages_change_nothing(monkeypatch, seed):
    """The same buckets, closers and late counts for pages of any width."""
    results = []
    for pages in (1, 7, 128, 10**9):
        rng = random.Random(seed)
        monkeypatch.setattr(stages, "PAGES", pages)
        stage, got = BucketStage(Handle()), []
        for step in range(30):
            batch = arrays([rng.randrange(-40, 60) * 500 + step * 4000 for _ in range(rng.randrange(1, 9))])
            batch["is_member"] = np.array([rng.random() < 0.8 for _ in batch["value"]])
            emitted, closers, late = stage.take(batch, 7000, "a=true")
            got.append((emitted, closers.tolist(), late.tolist()))
        results.append((got, stage.flush()))
    assert all(r == results[0] for r in results)


def test_late_rows_once_after_a_stop_between_the_writes(spark, tmp_path, monkeypatch):
    readings = random_readings(random.Random(5), 200)
    (tmp_path / "in").mkdir()
    timed = [(*r, i * 1000) for i, r in enumerate(readings)]
    stream = idle_stream(spark, tmp_path / "in", timed, 5)
    base, put, failed = str(tmp_path), side_output.put_batch, []

    def stops(part, path, batch_id):
        if path.endswith("late") and batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("stopped between the writes")
        put(part, path, batch_id)

    monkeypatch.setattr(side_output, "put_batch", stops)
    settings = VectorSettings.from_maps(spark)
    for _ in range(2):
        both = vector_stream_with_late_rows(stream, settings, timers=False)
        query = side_output.write_both(both, "both", f"{base}/checkpoint", f"{base}/emitted", f"{base}/late", "bounded")
        try:
            query.awaitTermination()
        except StreamingQueryException:
            assert failed
    assert failed == [2]
    emitted = side_output.read_batches(spark, side_output.emitted_schema(both), f"{base}/emitted").collect()
    late = side_output.read_batches(spark, side_output.late_schema(both), f"{base}/late").collect()
    rows, counts = replay_vectors(readings)
    got = [(r.key, r.bucket_ms, r.bucket_index, f, r["values"][f], v) for r in emitted for f, v in r.filled.items()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert {k: sum(r.key == k for r in late) for k in counts} == counts and sum(counts.values()) > 10
    for r in late:
        name, _, value, ts_us = readings[r.tie]
        assert (r.feature, r.value, r.ts_us) == (name, value, ts_us)
    assert len({(r.key, r.tie) for r in late}) == len(late)


def test_open_buckets_of_a_running_and_a_stopped_stream(spark, tmp_path):
    readings = random_readings(random.Random(8), 120)
    (tmp_path / "in").mkdir()
    stream = idle_stream(spark, tmp_path / "in", [(*r, i) for i, r in enumerate(readings)], 3)
    out = vector_stream(stream, VectorSettings.from_maps(spark), timers=False)
    keys = {v: Replay(WATERMARKS[v], LAYOUTS[v]) for v in WATERMARKS}
    for name, device, value, ts_us in readings:
        for vector in ROUTES[device]:
            keys[vector].feed(name, truncated(ts_us // 1000, STEPS[name]), ts_us, value)
    for key in keys.values():
        key.emit()
    want = sorted((v, b) for v, key in keys.items() for b in key.pools)
    checkpoint = str(tmp_path / "checkpoint")
    query = to_parquet(writer(out, "open", checkpoint, trigger=None), str(tmp_path / "out")).start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, open_buckets(spark, checkpoint).collect())) == want
    finally:
        query.stop()
        query.awaitTermination()
    assert sorted(map(tuple, open_buckets(spark, checkpoint).collect())) == want
    progress = {r.key: (r.newest_ms, r.watermark_ms) for r in key_progress(spark, checkpoint).collect()}
    assert progress == {v: (key.newest, key.watermark_ms) for v, key in keys.items()}
    early = open_buckets(spark, checkpoint, batch_id=0).count()
    assert early > 0
    cells = {(r.key, r.bucket_ms, r.feature): (r.n, r.total) for r in open_cells(spark, checkpoint).where("feature <> ''").collect()}
    assert cells == {
        (v, b, f): (len(seen), sum(x for _, x in seen)) for v, key in keys.items() for b, pool in key.pools.items() for f, seen in pool.items()
    }


def test_progress_table(spark, tmp_path):
    log = ProgressLog()
    event = SimpleNamespace(
        progress=SimpleNamespace(
            name="q", id="i", batchId=4, timestamp="2024-01-01T00:00:00.000Z",
            sources=[SimpleNamespace(endOffset='{"in": {"0": 7, "1": 9}, "more": {"0": 1}}', numInputRows=5), SimpleNamespace(endOffset="3", numInputRows=2)],
            observedMetrics={"rejected": Row(bad_json=3, fit=None)},
        )
    )
    log.onQueryProgress(event)
    rows = {tuple(r)[3:] for r in log.table(spark).collect()}
    assert rows == {
        (0, "in", 0, "offset", 7), (0, "in", 1, "offset", 9), (0, "more", 0, "offset", 1), (0, None, None, "rows_read", 5),
        (1, None, None, "rows_read", 2), (None, "rejected", None, "bad_json", 3),
    }
    for _ in range(2):
        log.write(spark, str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "progress")).count() == 6 and log.table(spark).count() == 0
    with pytest.raises(TimeoutError):
        log.wait("no such run", seconds=0.1)


def test_changed_settings_go_on_from_the_old_state(spark, tmp_path):
    """Other allowances, and a vector with one more feature; the same as a replay with that change."""
    readings = random_readings(random.Random(13), 200)
    old = VectorSettings.from_maps(spark)
    new_watermarks, new_layouts = {"v1": 25, "v2": 5, "v3": 30}, {**LAYOUTS, "v2": {"f3": True, "f4": True}}
    new = VectorSettings.from_maps(
        spark, watermarks_s=new_watermarks, vector_features={"v1": "f1,f2", "v2": "f3,f4", "v3": "f4"}
    )
    keys = {v: Replay(WATERMARKS[v], LAYOUTS[v]) for v in WATERMARKS}
    want = []
    for part, change in ((readings[:100], False), (readings[100:], True)):
        if change:
            for v, key in keys.items():
                key.watermark_ms, key.layout = new_watermarks[v] * 1000, new_layouts[v]
        for name, device, value, ts_us in part:
            for vector in ROUTES[device]:
                keys[vector].feed(name, truncated(ts_us // 1000, STEPS[name]), ts_us, value)
        want += [(v, *row) for v, key in keys.items() for row in key.emit()]
    got, initial = [], None
    for i, (part, settings) in enumerate(((readings[:100], old), (readings[100:], new))):
        folder = tmp_path / f"in{i}"
        folder.mkdir()
        timed = [(*r, 1000 * (100 * i + k)) for k, r in enumerate(part)]
        out = vector_stream(idle_stream(spark, folder, timed, 2), settings, timers=False, initial=initial)
        base = str(tmp_path / f"run{i}")
        start_bounded(out, f"run{i}", base).awaitTermination()
        rows = spark.read.schema(out.schema).parquet(f"{base}/out").collect()
        got += [(r.key, r.bucket_ms, r.bucket_index, f, r["values"][f], v) for r in rows for f, v in r.filled.items()]
        initial = carried(spark, f"{base}/checkpoint")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        vector_stream(idle_stream(spark, folder, timed, 2), new, form=chained, initial=initial)


def late_key(seed, n, lost=False):
    """Readings of one key in any order, as a micro-batch gives them: frames of up to 50 rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = rng.randrange(n // 2) * 1000  # several readings arrive at once, a few twice
        bucket = (at // 1000 - rng.choice([0, 0, 0, 5, 30])) * 500
        rows.append((bucket, rng.choice("abz"), bucket * 1000 + rng.randrange(9), rng.random(), at, rng.choice([i, i, i // 2])))
    frame = pd.DataFrame(rows, columns=["bucket_ms", "feature", "ts_us", "value", "arrival_us", "tie"])
    if lost:
        frame.loc[frame["tie"] % 7 == 0, "tie"] = np.nan
    frame["is_member"] = frame["feature"] != "z"
    frame = frame.assign(watermark_ms=7000, timeout_ms=40, layout="a=true,b=false")
    return [frame[at : at + 50] for at in range(0, n, 50)]


@pytest.mark.parametrize("lost", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_a_large_batch_is_taken_in_by_parts(seed, lost):
    """Sorted by parts of bounded size: the arrivals in order, the same buckets and late counts."""
    batches = late_key(seed, 4000, lost)
    names = [*stages.STAGED, *stages.ARRIVAL]
    found, parts = [], []
    for run_rows, block_rows in ((10**6, 10**6), (300, 20), (50, 1), (1000, 7)):
        batch = stages.InArrivalOrder(iter(batches), names, run_rows, block_rows)
        chunks = list(batch.chunks())
        parts.append(max(len(c["tie"]) for c in chunks))
        at = np.concatenate([np.array([c["arrival_us"], np.nan_to_num(c["tie"].astype(float), nan=np.inf)]).T for c in chunks])
        assert (batch.watermark, batch.timeout, batch.layout) == (7000, 40, "a=true,b=false")
        stage, closed, late = BucketStage(Handle()), [], Counter()
        for emitted, more in stage.update(stages.InArrivalOrder(iter(batches), stages.STAGED, run_rows, block_rows)):
            closed += [(b, {f: v and round(v, 9) for f, v in values.items()}) for b, values in emitted]
            late.update(more)
        rest = [(b, {f: v and round(v, 9) for f, v in values.items()}) for b, values in stage.flush()]
        found.append((at.tolist(), sorted(late.items()), [b for b, _ in closed], [v["b"] for _, v in closed], [b for b, _ in rest]))
    assert all(f == found[0] for f in found)
    assert parts[0] == 4000 and parts[1] < 800 and parts[2] < 300 and found[0][1]


def test_a_large_batch_is_not_held_whole():
    """Frames of a batch go as they are read; what is held does not grow with the batch."""
    held, most = [], 0

    def frames():
        nonlocal most
        for frame in late_key(1, 20_000):
            copy = frame.copy()
            held.append(weakref.ref(copy))
            yield copy
            del copy
            most = max(most, sum(ref() is not None for ref in held))

    batch = stages.InArrivalOrder(frames(), stages.STAGED, 1000, 50)
    assert most <= 1000 // 50 + 2 and sum(len(c["value"]) for c in batch.chunks()) == 20_000


def test_many_slots_are_joined_without_copies(spark, monkeypatch):
    """Shuffled, the slots are not copied, but for those with many readings. The rows are the same."""
    rng = random.Random(4)
    rows = [(rng.choice("abcd"), (rng.randrange(400) if rng.random() < 0.5 else 7) * 1_000_000, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "key string, us bigint, tie bigint").select(
        "key", arrival(F.col("us"), F.col("tie")).alias("arrival"), F.lit(2000).cast("bigint").alias("timeout_ms")
    ).repartition(3)
    epochs = find_epochs(frame, IdleClock())
    assert epochs.total_rows == 3000
    want = sorted(by_epoch(frame, epochs).collect(), key=repr)
    assert len(want) == 3000
    for hot_rows in (1_000_000, 50):
        monkeypatch.setattr(lateness, "HOT_ROWS", hot_rows)
        joined = by_epoch(frame, epochs, broadcast_bytes=0)
        assert sorted(joined.collect(), key=repr) == want
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "explode([0,1,2" not in plan and "_salts" in plan  # as many copies as the slot's rows need
