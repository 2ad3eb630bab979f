"""Exact duplicates by a stream with disk-backed keyed state.

Documents arrive as a stream. The keyed state has one entry per digest of a text and
keeps it for good (no watermark, so nothing expires): the largest id seen, the *locator*
of that row (file and row number) and how many rows had the digest. The state lives in
RocksDB on the executors' disks and in the checkpoint, so a stream that is started again
on the same state goes on where it ended, and a lost executor's state is loaded from the
checkpoint. Only functions of Spark are used.

A digest met more than once is a *hit*. For all hits the full bytes are fetched through
the locator and compared; rows that share a digest but not the text are grouped anew by
the text itself, so that the result never rests on the digest.

Defined cases: a null text counts as empty; a null ``doc_id`` ranks below every id; of
rows that repeat both id and text one stays; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import BROADCAST_BYTES, settings, text_or_empty
from tidemark.session import materialise, scratch_path

# What of a documents table the stream reads.
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Native memory of all stores of an executor together.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else each store sets aside several MB of disk for its logs before it has any.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Without watermark or timers a batch without data has nothing to do.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.metricsEnabled": "false",
}

# For a fold in one batch: else its stores, with several threads each, stay open for a minute or more.
# Not for many batches, as every store that is opened leaves native memory behind when it is closed.
ONE_BATCH = {**STATE, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}

# Bytes of a digest and its overhead in a broadcast hash table.
HIT_BYTES = 128


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def locator() -> Column:
    """Where a row stands: 64 bits of its file and row number. Told apart within a digest only."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def _located(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_or_empty()
    return rows.select(
        "doc_id",
        text.alias("text"),
        digest(text).alias("digest"),
        locator().alias("place"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("rank"),
    )


def fold(
    spark: SparkSession,
    path: str,
    state: str,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> None:
    """Stream the parquet files at ``path`` that are not yet in ``state`` into it.

    ``files_per_batch`` cuts the input into micro-batches; the state does not depend on it.
    """
    reader = spark.readStream.schema(SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = _located(reader.parquet(path), digest)
    entries = rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("place", "rank").alias("keep_place"),
        F.count(F.lit(1)).alias("group_size"),
    )
    with settings(spark, STATE if files_per_batch else ONE_BATCH):
        query = (
            entries.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def entries(spark: SparkSession, state: str) -> DataFrame:
    """The keyed state as a table, one row per digest."""
    with settings(spark, STATE):
        store = spark.read.format("statestore").load(state)
        names = store.schema["value"].dataType.names
    # As the aggregate above lays them out: max; value and order of max_by; count.
    keep_id, place, _, size = (F.col("value")[name] for name in names)
    return store.select(
        F.col("key")["digest"].alias("digest"),
        keep_id.alias("keep_id"),
        place.alias("keep_place"),
        size.alias("group_size"),
    )


def _hit_texts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows, with their whole texts, of the digests that were met more than once."""
    hits = known.where("group_size > 1").select("digest", "keep_place")
    n = hits.count()
    hits = F.broadcast(hits) if n * HIT_BYTES <= BROADCAST_BYTES else hits
    return rows.join(hits, "digest")


def _by_text(texts: DataFrame) -> DataFrame:
    """Groups of equal texts below one digest, in the form of :func:`entries`."""
    return texts.groupBy("digest", "text").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("place", "rank").alias("keep_place"),
        F.count(F.lit(1)).alias("group_size"),
    )


def _decided(rows: DataFrame, groups: DataFrame, on: list[str], *more: str) -> DataFrame:
    here = F.col("place") == F.col("keep_place")
    return rows.join(groups, on).select(
        "doc_id", "keep_id", "group_size", here.alias("kept"), "text_sha256", *more
    )


def decisions(
    spark: SparkSession,
    path: str,
    digest: Callable[[Column], Column] = sha256,
    state: str | None = None,
    files_per_batch: int | None = None,
    locators: bool = False,
) -> DataFrame:
    """One row per document of the files at ``path``, dropped ones too.

    Columns doc_id, keep_id, group_size, kept, text_sha256; with ``locators`` also digest
    and place. ``state`` names the folder of the keyed state (default: a new one below the
    shared folder); it must have been filled from the same path only.
    """
    state = state or scratch_path(spark, "dedup-state")
    fold(spark, path, state, digest, files_per_batch)
    # Read once, as that opens every store.
    known = materialise(entries(spark, state), "dedup-entries")
    rows = _located(spark.read.schema(SCHEMA).parquet(path), digest)
    more = ("digest", "place") if locators else ()

    texts = _hit_texts(rows, known)
    is_kept = F.col("place") == F.col("keep_place")
    keepers = texts.where(is_kept).select("digest", F.col("text").alias("keep_text"))
    copies = texts.where(~is_kept).select("digest", "text")
    wrong = copies.join(keepers, "digest").where("text <> keep_text").select("digest").distinct()
    named = rows.withColumn("text_sha256", F.sha2("text", 256))
    if wrong.isEmpty():
        return _decided(named.drop("text"), known, ["digest"], *more)
    sound = _decided(named.drop("text"), known.join(wrong, "digest", "left_anti"), ["digest"], *more)
    doubtful = named.join(wrong, "digest", "left_semi")
    return sound.unionByName(_decided(doubtful, _by_text(doubtful), ["digest", "text"], *more))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    A stream reads files, so the table is written to the shared folder once; the rows
    are then told by their place in it.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup-input")
    docs.write.parquet(path)
    stays = decisions(spark, path, locators=True).where("kept").select("digest", "place")
    rows = spark.read.schema(docs.schema).parquet(path)
    placed = rows.select(
        F.struct("*").alias("_row"),
        sha256(text_or_empty()).alias("digest"),
        locator().alias("place"),
    )
    return placed.join(stays, ["digest", "place"], "left_semi").select("_row.*")
