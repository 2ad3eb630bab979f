"""Feature vectors: assembly, forward fill and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Lookup
from tidemark.functions.payload import sorted_map, vector_json
from tidemark.functions.timegrain import bucket_timestamp
from tidemark.operators.lookup import lookup_join
from tidemark.operators.scan import Segments, last_known, row_index, running


def assemble(emitted: DataFrame, values: DataFrame, members: Lookup, also: tuple[str, ...] = ()) -> DataFrame:
    """Long form of the vectors: every feature of every emitted bucket.

    ``value`` is null where the feature was not seen in the bucket. ``also`` names columns
    that tell apart buckets which a key emits more than once.
    """
    layout = Lookup(
        members.frame.select(F.col("vector").alias("key"), "feature"), members.size
    )
    cells = lookup_join(emitted, layout, ["key"], spread="bucket_ms")
    by = ["key", *also, "bucket_ms", "feature"]
    return cells.join(values.select(*by, "value"), by, "left")


def forward_fill(cells: DataFrame, segments: Segments) -> DataFrame:
    """Add ``filled``: the value, or the feature's last known one before it."""
    return running(
        cells, ["key", "feature"], "bucket_ms", segments, last_known("value", "bucket_ms"), "filled"
    )


def number_buckets(emitted: DataFrame, segments: Segments) -> DataFrame:
    """Add ``bucket_index``: position of the bucket within its key, from 0."""
    numbered = running(emitted, ["key"], "bucket_ms", segments, row_index(), "bucket_index")
    return numbered.withColumn("bucket_index", F.col("bucket_index").cast("int"))


def pack(cells: DataFrame, value: str = "filled") -> DataFrame:
    """One row per vector and bucket with ``values``, a map in feature order."""
    entry = F.struct(F.col("feature"), F.col(value))
    return cells.groupBy("key", "bucket_ms").agg(
        sorted_map(F.collect_list(entry)).alias("values"),
        F.max("emit_reason").alias("emit_reason"),
    )


def to_messages(vectors: DataFrame) -> DataFrame:
    """``(key, value)`` text messages."""
    return vectors.select(
        F.col("key").cast("string").alias("key"),
        vector_json(bucket_timestamp(F.col("bucket_ms")), F.col("values")).alias("value"),
    )
