"""Ordered running aggregates over buckets, in bounded pieces.

A plain window partitioned by key sorts every bucket of a key in one task. Here
the time axis is cut into segments of at most ``SEGMENT_BUCKETS`` steps. Each
(key, segment) is scanned by itself; what earlier segments contribute is computed
from one total per segment and added by a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT_BUCKETS = 65_536


@dataclass(frozen=True)
class Segments:
    """Cut of the time axis: ``count`` segments of ``width_ms`` from ``base_ms``."""

    base_ms: int
    width_ms: int
    count: int

    @classmethod
    def over(cls, base_ms: int, top_ms: int, step_ms: int, buckets: int = SEGMENT_BUCKETS) -> Segments:
        width = max(step_ms * buckets, 1)
        return cls(base_ms, width, (top_ms - base_ms) // width + 1)

    def of(self, position_ms: Column) -> Column:
        return F.call_function("div", position_ms - F.lit(self.base_ms), F.lit(self.width_ms))


@dataclass(frozen=True)
class Running:
    """A running aggregate that can be put together from segments.

    ``local``  window aggregate within a segment, up to and including the row
    ``total``  aggregate of a whole segment
    ``carry``  aggregate of the totals of earlier segments
    ``merge``  result from (carry, local); carry is null in the first segment
    """

    local: Callable[[], Column]
    total: Callable[[], Column]
    carry: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]


def lowest(column: str) -> Running:
    return Running(
        lambda: F.min(column), lambda: F.min(column), F.min, lambda carry, local: F.least(carry, local)
    )


def highest(column: str) -> Running:
    return Running(
        lambda: F.max(column), lambda: F.max(column), F.max, lambda carry, local: F.greatest(carry, local)
    )


def total_of(column: str) -> Running:
    return Running(
        lambda: F.sum(column),
        lambda: F.sum(column),
        F.sum,
        lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    )


def last_known(column: str, *order: str) -> Running:
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return Running(
        lambda: F.last(column, ignorenulls=True),
        lambda: F.max_by(column, F.when(F.col(column).isNotNull(), at)),
        lambda total: F.last(total, ignorenulls=True),
        lambda carry, local: F.coalesce(local, carry),
    )


def row_index() -> Running:
    """Position of the row from 0."""
    return Running(
        lambda: F.count("*"),
        lambda: F.count("*"),
        F.sum,
        lambda carry, local: F.coalesce(carry, F.lit(0)) + local - F.lit(1),
    )


def running(
    frame: DataFrame,
    keys: list[str],
    order: str | list[str],
    segments: Segments,
    scan: Running,
    out: str,
    descending: bool = False,
    before: bool = False,
) -> DataFrame:
    """Add the running aggregate ``out`` over ``order`` within ``keys``.

    Rows with equal order see each other; segments cut the first column of the order.
    With ``before`` a row sees the rows before it only, and the order must be unique.
    With several segments ``frame`` is read twice, so pass a materialised table.
    """
    columns = [order] if isinstance(order, str) else order

    def ordered(names: list[str], by: list[str]) -> WindowSpec:
        direction = [F.col(c).desc() if descending else F.col(c).asc() for c in names]
        spec = Window.partitionBy(*by).orderBy(*direction)
        if before:
            return spec.rowsBetween(Window.unboundedPreceding, -1)
        return spec.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    if segments.count <= 1:
        local = scan.local().over(ordered(columns, keys))
        return frame.withColumn(out, scan.merge(F.lit(None), local))

    cut = frame.withColumn("_segment", segments.of(F.col(columns[0])))
    earlier = Window.partitionBy(*keys).orderBy(F.col("_segment").desc() if descending else F.col("_segment").asc())
    carry = (
        cut.groupBy(*keys, "_segment")
        .agg(scan.total().alias("_total"))
        .select(
            *keys,
            "_segment",
            scan.carry(F.col("_total")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        )
    )
    local = scan.local().over(ordered(columns, [*keys, "_segment"]))
    return (
        cut.withColumn("_local", local)
        .join(carry, [*keys, "_segment"], "left")
        .withColumn(out, scan.merge(F.col("_carry"), F.col("_local")))
        .drop("_segment", "_local", "_carry")
    )
