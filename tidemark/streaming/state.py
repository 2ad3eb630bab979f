"""What a stream knows, read from its checkpoint as tables: open buckets and how far keys are.

Spark's state reader gives the state as of the last committed micro-batch, of a running query or
of one that has stopped. Every executor reads its own state partitions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.processors import CELL, KEY, LAST
from tidemark.streaming.stages import OPENED


def _variable(spark: SparkSession, checkpoint: str, name: str, operator: int, batch_id: int | None) -> DataFrame:
    reader = spark.read.format("statestore").option("stateVarName", name).option("operatorId", operator)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def open_cells(spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """``key, bucket_ms, feature, total, n, latest_us, latest`` of the open buckets of a fused stream.

    A cell with an empty feature stands for the bucket itself.
    """
    pages = _variable(spark, checkpoint, "open", operator, batch_id)
    value = F.col("user_map_value")
    lists = ["buckets", "features", "total", "n", "latest_us", "latest"]
    cells = pages.select(F.col("key.key").alias("key"), F.explode(F.arrays_zip(*[value[c].alias(c) for c in lists])).alias("c"))
    return cells.select("key", F.col("c.buckets").alias("bucket_ms"), F.col("c.features").alias("feature"), *[F.col(f"c.{c}").alias(c) for c in lists[2:]])


def open_buckets(spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """``key, bucket_ms`` of the open buckets."""
    return open_cells(spark, checkpoint, operator, batch_id).where(F.col("feature") == OPENED).select("key", "bucket_ms")


def key_progress(spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """``key, newest_ms, watermark_ms, layout`` of every key that has open buckets or had rows since its last flush."""
    rows = _variable(spark, checkpoint, "progress", operator, batch_id)
    return rows.select(F.col("key.key").alias("key"), "value.newest_ms", "value.watermark_ms", "value.layout")


def carried(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """All that a stopped fused query knows, as the ``initial`` state of a new one.

    A stream cannot change its settings and keep its checkpoint: the new query gets a checkpoint
    of its own and goes on from these rows. Read them (or write them to a folder) once the old
    query has stopped. One row per open cell and last value, each with the key's progress.
    """
    progress = key_progress(spark, checkpoint, operator)
    index = _variable(spark, checkpoint, "next_index", operator, None)
    index = index.select(F.col("key.key").alias("key"), "value.next_index")
    last = _variable(spark, checkpoint, "last", operator, None)
    last = last.select(
        F.col("key.key").alias("key"), F.col("user_map_key.feature").alias("feature"), F.col("user_map_value.value").alias("latest")
    )
    keys = progress.select("key").union(index.select("key")).distinct().withColumn("kind", F.lit(KEY))
    rows = keys.unionByName(open_cells(spark, checkpoint, operator).withColumn("kind", F.lit(CELL)), allowMissingColumns=True)
    rows = rows.unionByName(last.withColumn("kind", F.lit(LAST)), allowMissingColumns=True)
    return rows.join(progress, "key", "left").join(index, "key", "left")
