"""Inactivity timeouts inside a table's history, on the clock of arrivals.

Replayed one reading at a time, a key that is quiet for longer than its timeout emits all its
open buckets and forgets its newest one. What lies between two such pauses is an *epoch*; each
is judged by itself, so a bucket that was emitted can come again in a later epoch.

A pause cannot lie within a *slot* of one timeout's width, so readings are first reduced to
the first and last arrival per (key, slot), which combines map-side. Pauses are found between
neighbouring slots of that small table by running aggregates in bounded segments; no key is
gathered. All readings of a slot have the same epoch, which they get by a join on (key, slot);
if that shuffles, only slots with very many readings are split.

A pause is longer than the timeout in whole milliseconds of arrival; a reading that arrives
just when the timeout ends is in time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.config import ROW_OVERHEAD_BYTES, Lookup
from tidemark.functions.timegrain import arrival_of
from tidemark.operators.lateness import Closings, sized_join
from tidemark.operators.lookup import BROADCAST_BYTES
from tidemark.operators.scan import SEGMENT_BUCKETS, Segments, highest, row_index, running, total_of
from tidemark.session import materialise

CLEANUP_MS = 5 * 60 * 1000


@dataclass(frozen=True)
class IdleClock:
    """``cleanup_ms``: pause of a key's output after which numbering and fill start anew.

    The clock stands at the newest arrival of all keys less ``delay_ms`` in the end; open
    buckets of keys whose timeout has ended by then are emitted.
    """

    cleanup_ms: int = CLEANUP_MS
    delay_ms: int = 0


@dataclass(frozen=True)
class Epochs:
    """``slots``: ``key, slot, epoch, n_rows``; ``ends``: ``key, epoch, expires_ms, ended`` for each epoch."""

    slots: Lookup
    ends: DataFrame
    segments: Segments
    total_rows: int


def arrival_ms() -> Column:
    return F.floor(F.col("arrival.us") / 1000)


def slot() -> Column:
    return F.floor(arrival_ms() / F.col("timeout_ms"))


def find_epochs(rows: DataFrame, clock: IdleClock, segment_buckets: int = SEGMENT_BUCKETS) -> Epochs:
    """From rows with ``key, arrival, timeout_ms``; every row of a key counts, late ones too."""
    seen = Observation()
    slots = rows.groupBy("key", slot().alias("slot")).agg(
        F.min(arrival_ms()).alias("first_ms"),
        F.max(arrival_ms()).alias("last_ms"),
        F.max("timeout_ms").alias("timeout_ms"),
        F.count("*").alias("n_rows"),
    )
    table = materialise(
        slots.observe(
            seen,
            F.count("*").alias("slots"),
            F.sum("n_rows").alias("rows"),
            F.min("first_ms").alias("base"),
            F.max("last_ms").alias("top"),
            F.max(F.col("last_ms") + F.col("timeout_ms")).alias("end"),
            F.min("timeout_ms").alias("step"),
            F.sum(F.octet_length(F.col("key").cast("string"))).cast("bigint").alias("key_bytes"),
        ),
        "slots",
    )
    totals = seen.get
    base = totals["base"] or 0
    segments = Segments.over(base, totals["end"] or base, totals["step"] or 1, segment_buckets)
    quiet = running(table, ["key"], "first_ms", segments, highest("last_ms"), "before_ms", before=True)
    begins = F.coalesce(F.col("first_ms") - F.col("before_ms") > F.col("timeout_ms"), F.lit(False))
    quiet = quiet.withColumn("begins", begins.cast("bigint"))
    if segments.count > 1:
        quiet = materialise(quiet, "pauses")
    numbered = running(quiet, ["key"], "first_ms", segments, total_of("begins"), "epoch")
    numbered = materialise(numbered.select("key", "slot", "epoch", "last_ms", "timeout_ms", "n_rows"), "epochs")
    ends = numbered.groupBy("key", "epoch").agg((F.max("last_ms") + F.max("timeout_ms")).alias("expires_ms"))
    newest = numbered.groupBy("key").agg(F.max("epoch").alias("newest"))
    stands = F.lit((totals["top"] or 0) - clock.delay_ms)
    ended = (F.col("epoch") < F.col("newest")) | (F.col("expires_ms") < stands)
    ends = ends.join(newest, "key").select("key", "epoch", "expires_ms", ended.alias("ended"))
    size = (totals["slots"] or 0) * (ROW_OVERHEAD_BYTES * 2) + (totals["key_bytes"] or 0)
    slots = Lookup(numbered.select("key", "slot", "epoch", "n_rows"), size)
    return Epochs(slots, ends, segments, totals["rows"] or 0)


def by_epoch(rows: DataFrame, epochs: Epochs, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with ``key`` made a pair of key and epoch, so that every epoch is a key of its own."""
    slots, on = epochs.slots.frame, ["key", "slot"]
    rows = rows.withColumn("slot", slot())
    if epochs.slots.size <= broadcast_bytes:
        joined = rows.join(F.broadcast(slots.drop("n_rows")), on)
    else:
        joined = sized_join(rows, slots, on, epochs.total_rows)
    return joined.withColumn("key", F.struct("key", "epoch")).drop("slot", "epoch")


def plain_key(frame: DataFrame) -> DataFrame:
    """``key`` and ``epoch`` as two columns again."""
    return frame.select(
        F.col("key.key").alias("key"), F.col("key.epoch").alias("epoch"), *[c for c in frame.columns if c != "key"]
    )


def emitted_by_epoch(closings: Closings, epochs: Epochs, flush: bool = False) -> DataFrame:
    """``key, epoch, bucket_ms, emit_reason, emitted_ms`` of buckets that closed or whose epoch ended.

    ``emitted_ms``: arrival of the reading that closed the bucket, or the end of the timeout.
    With ``flush`` the buckets still open in the end come too, at the end of their timeout.
    """
    opened = plain_key(closings.frame.where("opened").select("key", "bucket_ms", "closes_at"))
    ended = opened.join(epochs.ends, ["key", "epoch"])
    closed = F.col("closes_at").isNotNull()
    closed_ms = F.floor(arrival_of(F.col("closes_at")).getField("us") / 1000)
    due = ended if flush else ended.where(closed | F.col("ended"))
    return due.select(
        "key",
        "epoch",
        "bucket_ms",
        F.when(closed, F.lit("closed")).otherwise(F.lit("timeout")).alias("emit_reason"),
        F.when(closed, closed_ms).otherwise(F.col("expires_ms")).alias("emitted_ms"),
    )


# The order in which a key's buckets are emitted; segments cut the time of emission.
EMISSION = ["emitted_ms", "bucket_ms"]


def with_runs(emitted: DataFrame, clock: IdleClock, segments: Segments) -> DataFrame:
    """Adds ``run``: how often the key's output has paused for longer than ``cleanup_ms`` before."""
    quiet = running(emitted, ["key"], EMISSION, segments, highest("emitted_ms"), "_before", before=True)
    begins = F.coalesce(F.col("emitted_ms") - F.col("_before") > clock.cleanup_ms, F.lit(False))
    quiet = quiet.withColumn("_begins", begins.cast("bigint")).drop("_before")
    if segments.count > 1:
        quiet = materialise(quiet, "output-pauses")
    return running(quiet, ["key"], EMISSION, segments, total_of("_begins"), "run").drop("_begins")


def number_runs(emitted: DataFrame, segments: Segments) -> DataFrame:
    """Adds ``bucket_index``: position within the key's run, from 0."""
    numbered = running(emitted, ["key", "run"], EMISSION, segments, row_index(), "bucket_index")
    return numbered.withColumn("bucket_index", F.col("bucket_index").cast("int"))
