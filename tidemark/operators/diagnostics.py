"""Order checks over whole streams of rows.

A window with ``lag`` would gather a key's rows in one task. Instead the rows are
range-partitioned by (key, order): a busy key covers several ranges. Each range
is compared neighbour by neighbour in Arrow batches, and only the first and last
value per (range, key) are left for comparing neighbours across ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SUMMARY = "key string, piece int, n_rows bigint, breaks bigint, head double, tail double"
_FIELDS = pa.schema(
    [
        ("key", pa.string()),
        ("piece", pa.int32()),
        ("n_rows", pa.int64()),
        ("breaks", pa.int64()),
        ("head", pa.float64()),
        ("tail", pa.float64()),
    ]
)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of one key within a batch: rows, non-rising neighbours, first and last value.

    A key that continues from the batch before is joined up at the seam.
    """
    key = tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("key").dictionary_encode()
        code = codes.indices.to_numpy(zero_copy_only=False)
        values = batch.column("measure").to_numpy(zero_copy_only=False)
        fresh = np.r_[True, code[1:] != code[:-1]]
        starts = np.flatnonzero(fresh)
        ends = np.r_[starts[1:], len(code)]
        names = codes.dictionary.take(pa.array(code[starts]))
        broken = np.r_[False, values[1:] <= values[:-1]] & ~fresh
        broken[0] = names[0].as_py() == key and values[0] <= tail
        yield pa.record_batch(
            [
                names,
                batch.column("piece").take(pa.array(starts)),
                pa.array(ends - starts, pa.int64()),
                pa.array(np.add.reduceat(broken.astype(np.int64), starts)),
                pa.array(values[starts], pa.float64()),
                pa.array(values[ends - 1], pa.float64()),
            ],
            schema=_FIELDS,
        )
        key, tail = names[-1].as_py(), values[-1]


def order_breaks(rows: DataFrame, order: list[str], measure: str, out: str) -> DataFrame:
    """``(key, n_rows, out)``: rows whose ``measure`` is not above their predecessor's.

    Predecessor means the previous row of the same key in ``order``.
    """
    steps = [f"o{i}" for i, _ in enumerate(order)]
    ranged = (
        rows.select(
            F.col("key").cast("string").alias("key"),
            *[F.col(name).alias(step) for name, step in zip(order, steps)],
            F.col(measure).cast("double").alias("measure"),
        )
        .repartitionByRange("key", *steps)
        .sortWithinPartitions("key", *steps)
        .select("key", F.spark_partition_id().alias("piece"), "measure")
    )
    # Within a piece the summaries are already joined up; across pieces they are not.
    summaries = ranged.mapInArrow(_summarise, _SUMMARY)
    pieces = summaries.withColumn("at", F.monotonically_increasing_id()).groupBy("key", "piece").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("breaks").alias("breaks"),
        F.min_by("head", "at").alias("head"),
        F.max_by("tail", "at").alias("tail"),
    )
    previous = F.lag("tail").over(Window.partitionBy("key").orderBy("piece"))
    return (
        pieces.withColumn("seam", F.coalesce(F.col("head") <= previous, F.lit(False)).cast("int"))
        .groupBy("key")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("breaks") + F.col("seam")).alias(out))
    )
