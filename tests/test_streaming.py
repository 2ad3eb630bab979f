import os
import random
from functools import partial
import time
import uuid

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tests.check_oracle import table
from tests.replay import random_readings, replay_vectors, shaped_devices, shaped_keys
from tidemark.catalog import sql, streams
from tidemark.config import KeySettings, VectorSettings
from tidemark.operators.enrich import enrich_keyed
from tidemark.plans.keyed import KeyedJob, window_buckets
from tidemark.sources import kafka
from tidemark.sources.files import stream_folder, stream_table
from tidemark.streaming.jobs import (
    chained,
    fused,
    inactive_stream,
    keyed_stream,
    spread,
    vector_messages,
    vector_stream,
    vector_stream_rows,
)
from tidemark.streaming.listener import OffsetListener, end_offsets
from tidemark.streaming.run import (
    await_any,
    no_empty_batches,
    run_bounded,
    start_all,
    to_console,
    to_parquet,
    writer,
)
from tidemark.streaming.stages import parse_layout
from tidemark.streaming.watermark import windowed, windowed_union

DEVICE = pa.schema([("name", pa.string()), ("device", pa.string()), ("value", pa.float64()), ("ts_us", pa.int64()), ("seq", pa.int64())])
KEYED = pa.schema([("key", pa.string()), ("value", pa.float64()), ("ts_us", pa.int64()), ("seq", pa.int64())])


class Feed:
    """A folder fed one file at a time; each file becomes one micro-batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        self.files = self.seq = 0
        self.born = time.time() - 10_000

    def add(self, rows):
        rows = [(*row, self.seq + i) for i, row in enumerate(rows)]
        self.seq += len(rows)
        # Order within a file is not arrival order.
        random.Random(self.files).shuffle(rows)
        columns = list(zip(*rows))
        table = pa.table([pa.array(c, t.type) for c, t in zip(columns, self.schema)], schema=self.schema)
        hidden, path = f"{self.folder}/_part{self.files}", f"{self.folder}/part{self.files}.parquet"
        pq.write_table(table, hidden)
        os.utime(hidden, (self.born + self.files, self.born + self.files))
        os.replace(hidden, path)
        self.files += 1

    def stream(self):
        types = {"string": "string", "double": "double", "int64": "bigint"}
        ddl = ", ".join(f"{f.name} {types[str(f.type)]}" for f in self.schema)
        schema = StructType.fromDDL(ddl)
        raw = stream_folder(self.spark, self.folder, schema, files_per_trigger=1)
        return shaped_devices(raw) if self.schema is DEVICE else shaped_keys(raw)


def sliced(readings, slices):
    size = -(-len(readings) // slices)
    return [readings[i : i + size] for i in range(0, len(readings), size)]


def vector_rows(frame):
    out = frame.where("emit_reason <> 'late'").collect()
    return sorted(
        ((r.key, r.bucket_ms, r.bucket_index, f, r["values"][f], v) for r in out for f, v in r.filled.items()),
        key=repr,
    )


@pytest.mark.parametrize("slices, form", [(1, fused), (12, fused), (3, chained), (1, spread), (5, spread)])
def test_stream_equals_replay_for_any_slicing(spark, tmp_path, slices, form):
    readings = random_readings(random.Random(11), 240)
    feed = Feed(spark, tmp_path, DEVICE)
    for part in sliced(readings, slices):
        feed.add(part)
    out = run_bounded(
        vector_stream(feed.stream(), VectorSettings.from_maps(spark), timers=False, report_late=True, form=form),
        "sliced",
    )
    rows, late = replay_vectors(readings)
    assert vector_rows(out) == sorted(rows, key=repr)
    reported = {r.key: r.n for r in out.where("emit_reason = 'late'").groupBy("key").agg(F.sum("n_late").alias("n")).collect()}
    assert reported == late


def test_messages(spark, tmp_path):
    feed = Feed(spark, tmp_path, DEVICE)
    feed.add([("f1", "d0", 1.0, 5_000_000), ("f1", "d0", 2.0, 30_000_000)])
    out = run_bounded(vector_messages(vector_stream(feed.stream(), VectorSettings.from_maps(spark), timers=False)), "msg")
    assert [tuple(r) for r in out.collect()] == [
        ("v1", '{"bucket":"1970-01-01T00:00:05.000Z","values":{"f1":1.0,"f2":null}}')
    ]


def test_bounded_run_with_timers_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, KEYED)
    feed.add([("m", 1.0, 100_000_000), ("m", 2.0, 130_000_000)])
    with no_empty_batches(spark):
        out = run_bounded(keyed_stream(feed.stream(), KeySettings.from_maps(spark)), "timed")
    assert [(r.bucket_ms, r.bucket_index, r.value, r.emit_reason) for r in out.collect()] == [(100_000, 0, 1.0, "closed")]


class Live:
    """A running query with a memory of what it wrote."""

    def __init__(self, frame):
        self.spark = frame.sparkSession
        self.name = f"live_{uuid.uuid4().hex}"
        self.query = frame.writeStream.format("memory").queryName(self.name).outputMode("append").trigger(processingTime="200 milliseconds").start()

    def rows(self, *columns):
        return [tuple(r) for r in self.spark.table(self.name).select(*columns).collect()]

    def wait(self, count, *columns, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            if self.query.exception():
                raise self.query.exception()
            if len(rows := self.rows(*columns)) >= count:
                return rows
            time.sleep(0.2)
        raise AssertionError(f"{count} rows expected, got {self.rows(*columns)}")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.query.stop()


@pytest.mark.parametrize("form", [fused, chained, spread])
def test_inactivity_flushes_restarts_and_cleans_up(spark, tmp_path, form):
    settings = VectorSettings.from_maps(spark, timeout_ms=1500)
    feed = Feed(spark, tmp_path, DEVICE)
    feed.add([("f1", "d0", 1.0, 5_000_000), ("f1", "d0", 2.0, 30_000_000), ("f2", "d1", 3.0, 31_000_000)])
    rows = vector_stream_rows(feed.stream(), settings)
    columns = ("bucket_ms", "bucket_index", "values", "filled", "emit_reason")
    with Live(form(rows, cleanup_ms=15_000)) as live:
        first = live.wait(2, *columns)
        assert first[0] == (5000, 0, {"f1": 1.0, "f2": None}, {"f1": 1.0, "f2": None}, "closed")
        assert first[1] == (30_000, 1, {"f1": 2.0, "f2": 3.0}, {"f1": 2.0, "f2": 3.0}, "timeout")
        # The newest bucket is forgotten, so an old reading is accepted again; index
        # and last values are still known.
        feed.add([("f1", "d0", 9.0, 5_000_000)])
        assert live.wait(3, *columns)[2] == (5000, 2, {"f1": 9.0, "f2": None}, {"f1": 9.0, "f2": 3.0}, "timeout")
        time.sleep(18)
        feed.add([("f1", "d0", 4.0, 5_000_000)])
        assert live.wait(4, *columns)[3] == (5000, 0, {"f1": 4.0, "f2": None}, {"f1": 4.0, "f2": None}, "timeout")


def test_quiet_buckets_come_after_inactivity(spark, tmp_path):
    settings = KeySettings.from_maps(spark, watermarks_s={"m": 2, "f": 2})
    feed = Feed(spark, tmp_path, KEYED)
    feed.add([("m", 5.0, 100_000_000), ("m", 9.0, 100_000_000), ("f", 1.0, 90_000_000), ("m", 1.0, 10_000_000)])
    feed.add([("m", 7.0, 100_000_000), ("f", 2.0, 90_000_001)])
    with Live(inactive_stream(feed.stream(), settings)) as live:
        got = live.wait(3, "key", "bucket_ms", "value")
    assert sorted(got) == [("f", 90_000, 1.5), ("m", 10_000, 1.0), ("m", 100_000, 7.0)]


@pytest.fixture
def people_feed(spark, tmp_path):
    rng = random.Random(2)
    readings = [(k, float(rng.randint(1, 9)), s * 1_000_000) for s in range(0, 300, 3) for k in ("m", "f")]
    feed = Feed(spark, tmp_path, KEYED)
    for part in sliced(readings, 4):
        feed.add(part)
    table = spark.read.parquet(str(tmp_path))
    return feed, shaped_keys(table)


def test_watermarked_queries_equal_closed_windows(spark, people_feed):
    feed, table = people_feed
    settings = KeySettings.from_maps(spark)
    streamed = [
        run_bounded(windowed(enrich_keyed(feed.stream(), settings), key, *setting), f"w-{key}")
        for key, setting in {"m": (5000, 20_000, True), "f": (10_000, 30_000, False)}.items()
    ]
    expected = window_buckets(table, settings)
    assert sorted(map(tuple, streamed[0].union(streamed[1]).collect())) == sorted(map(tuple, expected.collect()))


def test_union_closes_by_slowest_key(spark, people_feed):
    feed, table = people_feed
    settings = KeySettings.from_maps(spark)
    rows = enrich_keyed(feed.stream(), settings)
    out = run_bounded(windowed_union(rows, {"m": (5000, 20_000, True), "f": (10_000, 30_000, False)}), "union")
    everything = window_buckets(table, settings, closed_only=False)
    step = F.when(F.col("key") == "m", 5000).otherwise(10_000)
    expected = everything.where(F.col("bucket_ms") + step <= (297 - 30) * 1000)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, expected.collect()))


def test_console_several_queries_and_listener(spark, people_feed):
    feed, _ = people_feed
    seen = []
    listener = OffsetListener(lambda query, batch, offsets: seen.append((query, batch, offsets)))
    spark.streams.addListener(listener)
    base = f"{feed.folder}-runs-{uuid.uuid4().hex}"
    try:
        queries = start_all(
            [
                to_console(writer(feed.stream().select("key", "value"), "shown", f"{base}/a", "bounded")),
                to_parquet(writer(feed.stream().select("key", "value"), "kept", f"{base}/b", "bounded"), f"{base}/out", "key"),
            ]
        )
        assert {q.name for q in queries} == {"shown", "kept"}
        await_any(spark)
        for query in queries:
            query.awaitTermination()
        end = time.time() + 20
        while {q for q, _, _ in seen} != {"shown", "kept"} and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert {q for q, _, _ in seen} == {"shown", "kept"} and all(o == [] for _, _, o in seen)
    assert spark.read.parquet(f"{base}/out").where("key = 'm'").count() == 100
    assert all(query.exception() is None for query in queries)


def test_end_offsets():
    assert end_offsets('{"test": {"8": 5, "0": 7}, "other": {"1": 2}}') == [("other", 1, 2), ("test", 0, 7), ("test", 8, 5)]
    assert end_offsets(None) == end_offsets('{"logOffset": 3}') == end_offsets("7") == end_offsets("x") == []


def test_kafka_options(spark):
    assert kafka.source_options("host:1", "in", 5) == {
        "kafka.bootstrap.servers": "host:1", "subscribe": "in", "maxOffsetsPerTrigger": "5",
    }
    assert "maxOffsetsPerTrigger" not in kafka.source_options()
    assert kafka.sink_options() == {"kafka.bootstrap.servers": "localhost:9092", "topic": "test-out"}


def test_table_as_stream(spark):
    stream = stream_table(spark, "/root/testdata/sf0.001", "events")
    assert stream.isStreaming and "event_id" in stream.columns
    counted = run_bounded(stream.select("event_id"), "table")
    assert counted.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


STREAMS = [name for name in streams.QUERIES]


@pytest.fixture(scope="module")
def several_files(tmp_path_factory):
    """The events in five files, oldest first; rows within a file are not in order."""
    folder = tmp_path_factory.mktemp("events")
    table = folder / "events.parquet"
    table.mkdir()
    events = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by("event_id")
    size = -(-len(events) // 5)
    for i in range(5):
        part = events.slice(i * size, size).sort_by("value")
        path = table / f"part-{i}.parquet"
        pq.write_table(part, path)
        os.utime(path, (time.time() - 1000 + i,) * 2)
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_stream_of_several_micro_batches_equals_sql(spark, several_files, monkeypatch, name):
    monkeypatch.setattr(streams, "stream_table", partial(stream_table, files_per_trigger=1))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{several_files}/events.parquet/*.parquet')")
    answer = connection.execute(sql.SQL[name])
    names = [d[0] for d in answer.description]
    frame = streams.QUERIES[name](spark, several_files)
    assert sorted(frame.columns) == sorted(names)
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == table(names, answer.fetchall())


@pytest.mark.parametrize("form", [fused, chained, spread])
def test_restart_from_the_checkpoint(spark, tmp_path, form):
    readings = random_readings(random.Random(23), 160)
    (tmp_path / "in").mkdir()
    feed = Feed(spark, tmp_path / "in", DEVICE)
    parts = sliced(readings, 6)

    def run():
        """One life of the query, on an interval trigger, until it has taken all files."""
        out = vector_stream(feed.stream(), VectorSettings.from_maps(spark), timers=False, form=form)
        started = to_parquet(
            writer(out, "restarted", str(tmp_path / "checkpoint"), trigger="1 second"), str(tmp_path / "out")
        ).start()
        try:
            started.processAllAvailable()
        finally:
            started.stop()
            started.awaitTermination()

    for part in parts[:3]:
        feed.add(part)
    run()
    for part in parts[3:]:
        feed.add(part)
    run()
    schema = vector_stream(feed.stream(), VectorSettings.from_maps(spark), timers=False, form=form).schema
    written = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    rows, _ = replay_vectors(readings)
    assert vector_rows(written) == sorted(rows, key=repr)


@pytest.mark.parametrize("form", [fused, spread])
def test_one_key_with_most_rows(spark, tmp_path, form):
    rng = random.Random(9)
    rows = [("m" if rng.random() < 0.9 else "f", float(i), rng.randrange(0, 4_000) * 100_000) for i in range(600)]
    feed = Feed(spark, tmp_path, KEYED)
    for part in sliced(rows, 4):
        feed.add(part)
    out = run_bounded(
        keyed_stream(feed.stream(), KeySettings.from_maps(spark), timers=False, form=form, salts=5), "busy"
    )
    feed_all = spark.read.schema("key string, value double, ts_us bigint, seq bigint").parquet(str(tmp_path))
    job = KeyedJob(KeySettings.from_maps(spark))
    want = {(r.key, r.bucket_ms, round(r.value, 9)) for r in job.buckets(shaped_keys(feed_all)).collect()}
    assert {(r.key, r.bucket_ms, round(r.value, 9)) for r in out.collect()} == want and want


def test_layout():
    assert parse_layout("a=b=true,f2=false") == {"a=b": True, "f2": False}
    assert parse_layout("") == {}
