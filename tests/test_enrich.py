import pytest
from pyspark.sql import functions as F

from tests.replay import device_frame, key_frame
from tidemark.config import KeySettings, Lookup, VectorSettings
from tidemark.operators.diagnostics import order_breaks
from tidemark.operators.enrich import REJECT, enrich_keyed, enrich_vectors, tag_keyed, tag_vectors, unfit
from tidemark.operators.lookup import lookup_join
from tidemark.schemas import READING
from tidemark.sources.messages import decode, parse, with_arrival


def records(spark, texts):
    rows = [(f"k{i}".encode(), None if t is None else t.encode(), i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "key binary, value binary, offset bigint")
    return frame.select("key", "value", F.timestamp_micros(F.lit(1)).alias("timestamp"), F.lit(0).alias("partition"), "offset")


def test_parse_and_reject_reasons(spark):
    good = '{"name": "f1", "device": "d0", "value": 7, "timestamp": 7}'
    texts = [
        good, "garbage", None, good.replace('"value": 7, ', ""), good.replace("d0", "d9"),
        good.replace("f1", "f9"), good.replace("7,", '"NaN",'), good.replace("7,", '"x",'),
        good.replace("d0", "d2").replace("f1", "f3"), good.replace("7,", "1e999,"),
    ]
    parsed = parse(with_arrival(decode(records(spark, texts))), READING, "offset", "arrival")
    settings = VectorSettings.from_maps(spark)
    reasons = {r.offset: r[REJECT] for r in unfit(tag_vectors(parsed, settings)).collect()}
    assert reasons == {
        1: "bad_json", 2: "bad_json", 3: "null_field", 4: "unknown_device", 5: "unknown_feature",
        6: "non_finite", 7: "bad_json", 9: "non_finite",
    }
    rows = enrich_vectors(parsed, settings)
    assert sorted((r.key, r.bucket_ms, r.is_member) for r in rows.collect()) == [
        ("v1", 5000, True), ("v2", 5000, True), ("v3", 5000, False),
    ]


def test_integer_timestamp_is_epoch_seconds(spark):
    parsed = parse(decode(records(spark, ['{"timestamp": 7}', '{"timestamp": "1970-01-01T00:00:08Z"}'])), READING)
    assert [r[0] for r in parsed.select(F.unix_seconds("timestamp")).collect()] == [7, 8]


def test_record_order(spark):
    rows = with_arrival(decode(records(spark, ["a", "b", "c"]))).orderBy(F.col("arrival").desc())
    assert [r.offset for r in rows.collect()] == [2, 1, 0]


def test_record_without_arrival_is_rejected(spark):
    text = '{"name": "f1", "device": "d0", "value": 1, "timestamp": 5}'
    far = records(spark, [text, text]).withColumn("offset", F.when(F.col("offset") == 0, 2**50).otherwise(F.col("offset")))
    parsed = parse(with_arrival(decode(far)), READING, "offset", "arrival")
    settings = VectorSettings.from_maps(spark)
    assert [(r.offset, r[REJECT]) for r in unfit(tag_vectors(parsed, settings)).collect()] == [(2**50, "no_arrival")]
    assert enrich_vectors(parsed, settings).count() == 1


def test_unknown_key_is_rejected(spark):
    tagged = tag_keyed(key_frame(spark, [("m", 1, 1), ("x", 1, 1)]), KeySettings.from_maps(spark))
    assert [(r.key, r[REJECT]) for r in unfit(tagged).collect()] == [("x", "unknown_key")]


def test_large_lookup_is_salted_not_broadcast(spark):
    rows = key_frame(spark, [("m", i, i) for i in range(100)] + [("f", 1, 1), ("x", 1, 1)])
    table = Lookup.measure(spark.createDataFrame([("m", 1), ("f", 2)], "key string, setting int"))
    for how in ("inner", "left"):
        small = lookup_join(rows, table, ["key"], how)
        large = lookup_join(rows, table, ["key"], how, broadcast_bytes=0)
        assert sorted(map(str, small.select("key", "value", "setting").collect())) == sorted(
            map(str, large.select("key", "value", "setting").collect())
        )
    plan = large._jdf.queryExecution().sparkPlan().toString()
    assert "_salt" in plan and "key" in plan


def test_settings_are_checked(spark):
    columns = "key string, step_ms int, agg string, watermark_s int"
    for rows in ([("a", 0, "latest", 1)], [("a", 1, "latest", 0)], [("a", 1, "x", 1), ("a", 2, "x", 1)]):
        with pytest.raises(ValueError):
            KeySettings.from_frame(spark.createDataFrame(rows, columns))
    with pytest.raises(ValueError):
        KeySettings.from_maps(spark, watermarks_s={"m": 20})
    with pytest.raises(ValueError):
        VectorSettings.from_maps(spark, device_vectors={"d0": "v9"})


def test_settings_from_tables_equal_settings_from_maps(spark):
    tables = VectorSettings.from_frames(
        spark.createDataFrame([("d0", "v1"), ("d1", "v1"), ("d2", "v2,v3")], "device string, vector string"),
        spark.createDataFrame([("v1", 10), ("v2", 20), ("v3", 30)], "vector string, watermark_s int"),
        spark.createDataFrame([("v1", "f1,f2"), ("v2", "f3"), ("v3", "f4")], "vector string, feature string"),
        spark.createDataFrame(
            [("f1", 5000, "average"), ("f2", 10000, "average"), ("f3", 5000, "latest"), ("f4", 5000, "latest")],
            "feature string, step_ms int, agg string",
        ),
    )
    maps = VectorSettings.from_maps(spark)
    for name in ("fan_out", "features", "members"):
        left, right = getattr(tables, name).frame, getattr(maps, name).frame
        assert sorted(map(tuple, left.select(*right.columns).collect())) == sorted(map(tuple, right.collect()))


def test_watermark_in_milliseconds_does_not_overflow(spark):
    settings = KeySettings.from_maps(spark, {"m": 5000}, {"m": "latest"}, {"m": 3_000_000})
    row = enrich_keyed(key_frame(spark, [("m", 1, 1)]), settings).first()
    assert row.watermark_ms == 3_000_000_000


def test_plan_reads_needed_columns_and_broadcasts_settings(spark):
    from tidemark.catalog import batch

    rows = batch._vector_rows(spark, "/root/testdata/sf0.001")
    plan = rows.select("key", "bucket_ms")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert "props" not in plan and "Exchange hashpartitioning" not in plan
    people = batch.one_key(spark, "/root/testdata/sf0.001")
    assert "PushedFilters: [" in people._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_order_breaks_across_ranges_and_batches(spark, partitions):
    values = [(k, i, float((i * 7919 + len(k)) % 101 if i % 50 else i)) for k in ("a", "bb") for i in range(2000)]
    values += [("ccc", 1, 5.0)]
    expected = {
        k: sum(b[2] <= a[2] for a, b in zip(rows, rows[1:]))
        for k in ("a", "bb", "ccc")
        for rows in [[v for v in values if v[0] == k]]
    }
    conf = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.execution.arrow.maxRecordsPerBatch": "37",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        frame = spark.createDataFrame(values, "key string, at bigint, value double").repartition(5)
        got = {r.key: (r.n_rows, r.n) for r in order_breaks(frame, ["at"], "value", "n").collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {k: n for k, (_, n) in got.items()} == expected
    assert got["a"][0] == 2000
