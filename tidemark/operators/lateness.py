"""Per-key lateness over a whole table, without sorting the readings.

Replayed one reading at a time, a reading is late when an earlier arrival of its
key has already moved the newest bucket ``watermark_ms`` or more beyond it::

    newest_bucket_so_far - watermark_ms >= bucket

Turned round: bucket ``b`` closes with the *first arrival of any member reading
whose bucket is at least b + watermark_ms*, and every reading of ``b`` arriving
after that point is late. The closing point depends on (key, bucket) only, so

1. one aggregate per (key, bucket) finds the first arrival of every bucket. It
   combines map-side; no key is gathered anywhere;
2. a running minimum over that small table, newest bucket first, gives the
   closing point of each bucket;
3. readings are compared with the closing point of their bucket. Only buckets
   whose last arrival is not before it take part in that join.

A bucket with a closing point is *closed*; one without is still open at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.config import ROW_OVERHEAD_BYTES
from tidemark.functions.timegrain import arrival_of, arrival_rank, arrived_before, rank_after
from tidemark.operators.lookup import BROADCAST_BYTES
from tidemark.operators.scan import SEGMENT_BUCKETS, Segments, lowest, running
from tidemark.session import materialise

# Most (key, bucket) pairs that may be marked as hot; bounds the broadcast of them.
HOT_BUCKETS = 10_000
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Closings:
    """Per (key, bucket): when it closed, whether it was opened, whether rows may be late.

    Columns ``key, bucket_ms, watermark_ms, n_rows, closes_at, opened, dirty``;
    ``closes_at`` is an arrival rank.
    """

    frame: DataFrame
    segments: Segments
    size: int
    total_rows: int


def bucket_marks(rows: DataFrame) -> DataFrame:
    """First and last arrival per (key, bucket), as ranks.

    The newest bucket starts at the epoch, so buckets at or below
    ``-watermark_ms`` are late from the start and never counted.
    """
    rank = arrival_rank(F.col("arrival"))
    return (
        rows.where(F.col("bucket_ms") > -F.col("watermark_ms"))
        .groupBy("bucket_ms", "key")
        .agg(
            F.min(F.when(F.col("is_member"), rank)).alias("first_member"),
            F.min(F.when(~F.col("is_member"), rank)).alias("first_foreign"),
            F.max("arrival.us").alias("last_us"),
            F.count("*").alias("n_rows"),
            F.max("watermark_ms").alias("watermark_ms"),
            F.min("step_ms").alias("step_ms"),
        )
    )


def closing_points(
    rows: DataFrame,
    only_member_buckets: bool = False,
    segment_buckets: int = SEGMENT_BUCKETS,
) -> Closings:
    """Run the first pass over ``rows`` and work out the closing point of every bucket.

    With ``only_member_buckets`` a bucket is opened by member readings alone.
    """
    seen = Observation()
    marks = bucket_marks(rows).observe(
        seen,
        F.count("*").alias("buckets"),
        F.sum("n_rows").alias("rows"),
        F.min("bucket_ms").alias("base"),
        F.max(F.col("bucket_ms") + F.col("watermark_ms")).alias("top"),
        F.min("step_ms").alias("step"),
        F.sum(F.octet_length(F.col("key").cast("string"))).cast("bigint").alias("key_bytes"),
    )
    table = materialise(marks, "buckets")
    totals = seen.get
    base = totals["base"] or 0
    segments = Segments.over(base, totals["top"] or base, totals["step"] or 1, segment_buckets)

    first = F.col("first_member")
    opener = first if only_member_buckets else F.least(first, F.col("first_foreign"))
    # One pass turns each bucket into its own mark and into a probe at the
    # position whose arrival closes it.
    missing = F.lit(None)
    mark = F.struct(
        F.col("bucket_ms").alias("position"),
        F.col("first_member").alias("mark"),
        missing.cast("bigint").alias("bucket_ms"),
    )
    probe = F.struct(
        (F.col("bucket_ms") + F.col("watermark_ms")).alias("position"),
        missing.cast(table.schema["first_member"].dataType).alias("mark"),
        F.col("bucket_ms").alias("bucket_ms"),
    )
    kept = ["key", "watermark_ms", "n_rows", "last_us", "opener"]
    points = table.withColumn("opener", opener)
    points = points.select(*kept, F.explode(F.array(mark, probe)).alias("p")).select(*kept, "p.*")
    closed = (
        running(points, ["key"], "position", segments, lowest("mark"), "closes_at", descending=True)
        if segments.count <= 1
        else _closed_by_segment(points, segments)
    )
    frame = closed.where(F.col("bucket_ms").isNotNull()).select(
        "key",
        "bucket_ms",
        "watermark_ms",
        "n_rows",
        "closes_at",
        (
            F.col("opener").isNotNull()
            & (F.col("closes_at").isNull() | (F.col("opener") < F.col("closes_at")))
        ).alias("opened"),
        F.coalesce(rank_after(F.col("last_us")) > F.col("closes_at"), F.lit(False)).alias("dirty"),
    )
    size = (totals["buckets"] or 0) * (ROW_OVERHEAD_BYTES * 2) + (totals["key_bytes"] or 0)
    return Closings(frame, segments, size, totals["rows"] or 0)


def _closed_by_segment(points: DataFrame, segments: Segments) -> DataFrame:
    scanned = running(
        points, ["key"], "position", segments, lowest("mark"), "closes_at", descending=True
    )
    # Closing points are read by several later steps.
    return materialise(scanned, "closings")


def judge(rows: DataFrame, closings: Closings, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``accepted`` to every row.

    Only buckets with late rows are joined. If they are small (measured) they are
    broadcast and the rows are not shuffled at all; otherwise the join shuffles,
    with the buckets holding most rows split by salt.
    """
    dirty = closings.frame.where("dirty").select(
        "key", "bucket_ms", arrival_of(F.col("closes_at")).alias("closed_by"), "n_rows"
    )
    if closings.size > broadcast_bytes:
        counted = Observation()
        dirty = materialise(
            dirty.observe(
                counted,
                F.count("*").alias("buckets"),
                F.sum(F.octet_length(F.col("key").cast("string"))).cast("bigint").alias("key_bytes"),
            ),
            "dirty",
        )
        size = counted.get["buckets"] * (ROW_OVERHEAD_BYTES * 2) + (counted.get["key_bytes"] or 0)
    else:
        size = closings.size
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(dirty.drop("n_rows")), ["key", "bucket_ms"], "left")
    else:
        joined = sized_join(rows, dirty, ["key", "bucket_ms"], closings.total_rows, "left")
    closed_by = F.col("closed_by")
    in_time = closed_by.isNull() | arrived_before(F.col("arrival"), closed_by)
    return joined.withColumn(
        "accepted", (F.col("bucket_ms") > -F.col("watermark_ms")) & in_time
    ).drop("closed_by")


def sized_join(rows: DataFrame, table: DataFrame, on: list[str], total_rows: int, how: str = "inner") -> DataFrame:
    """Join with a table that has the number of rows of each of its groups, ``n_rows``.

    Hot groups are split into pieces of similar size, the others are copied nowhere. A hot
    group holds more than ``total_rows / HOT_BUCKETS`` rows, so there are at most
    ``HOT_BUCKETS`` of them and the list can be broadcast.
    """
    piece = max(HOT_ROWS, total_rows // HOT_BUCKETS)
    salts = F.ceil(F.col("n_rows") / F.lit(piece)).cast("int")
    sized = table.withColumn("_salts", F.greatest(salts, F.lit(1))).drop("n_rows")
    hot = sized.where("_salts > 1").select(*on, "_salts")
    copies = sized.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - F.lit(1)))
    ).drop("_salts")
    salt = F.pmod(F.xxhash64("arrival"), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    return (
        rows.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", salt)
        .drop("_salts")
        .join(copies, [*on, "_salt"], how)
        .drop("_salt")
    )


def accepted_rows(judged: DataFrame) -> DataFrame:
    return judged.where("accepted").drop("accepted")


def late_rows(judged: DataFrame) -> DataFrame:
    """Rows that came after their bucket had closed."""
    return judged.where(~F.col("accepted")).drop("accepted")


def late_report(judged: DataFrame) -> DataFrame:
    """Accepted and late rows per key."""
    return judged.groupBy("key").agg(
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_late"),
    )


def emitted_buckets(closings: Closings, flush: bool = False) -> DataFrame:
    """``(key, bucket_ms, emit_reason)`` of closed buckets, with ``flush`` also the open ones."""
    closed = F.col("closes_at").isNotNull()
    opened = closings.frame.where("opened")
    return (opened if flush else opened.where(closed)).select(
        "key",
        "bucket_ms",
        F.when(closed, F.lit("closed")).otherwise(F.lit("timeout")).alias("emit_reason"),
    )
