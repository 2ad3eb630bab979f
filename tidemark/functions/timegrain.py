"""Column expressions for event time, bucket time and arrival order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_us(timestamp: Column) -> Column:
    return F.unix_micros(timestamp)


def event_ms(timestamp: Column) -> Column:
    return F.unix_millis(timestamp)


def coarse_grain(ms: Column, step_ms: Column) -> Column:
    """Bucket of an epoch-millisecond time; integer division truncates toward zero.

    Before 1970 this differs from ``window()``, which floors.
    """
    return F.call_function("div", ms, step_ms) * step_ms


def window_start(us: Column, step_ms: Column) -> Column:
    """Start, in epoch milliseconds, of the tumbling window ``window()`` would give.

    ``window()`` takes a constant width; this takes one per row.
    """
    step_us = step_ms.cast("bigint") * F.lit(1000)
    return F.call_function("div", us - F.pmod(us, step_us), F.lit(1000))


def bucket_timestamp(bucket_ms: Column) -> Column:
    return F.timestamp_millis(bucket_ms)


def arrival(time_us: Column, tie: Column) -> Column:
    """Total arrival order: arrival time, then a tie-breaker unique within that time.

    Structs compare field by field, so the order needs no global numbering.
    """
    return F.struct(time_us.cast("bigint").alias("us"), tie.cast("bigint").alias("tie"))


# A tie-breaker lies within plus or minus the half step, so that none
# reaches the ranks of the next time.
_STEP = "20000000000000000000"
_HALF_STEP = "10000000000000000000"


def _whole(text: str) -> Column:
    return F.lit(text).cast("decimal(20,0)")


def arrival_rank(arrived: Column) -> Column:
    """The same order as one decimal.

    Minimum and maximum of a decimal are hash aggregates; those of a struct sort
    their whole input first.
    """
    time_us, tie = arrived.getField("us"), arrived.getField("tie")
    return time_us.cast("decimal(19,0)") * _whole(_STEP) + tie.cast("decimal(19,0)")


def rank_after(time_us: Column) -> Column:
    """A rank above every arrival at ``time_us`` and below every later one."""
    return time_us.cast("decimal(19,0)") * _whole(_STEP) + _whole(_HALF_STEP)


def arrival_of(rank: Column) -> Column:
    """The arrival a rank was made from."""
    tie = F.pmod(rank + _whole(_HALF_STEP), _whole(_STEP)) - _whole(_HALF_STEP)
    return arrival(F.call_function("div", rank - tie, _whole(_STEP)), tie)


def arrived_before(arrived: Column, other: Column) -> Column:
    """Whether ``arrived`` comes before ``other``."""
    time_us, limit_us = arrived.getField("us"), other.getField("us")
    same = (time_us == limit_us) & (arrived.getField("tie") < other.getField("tie"))
    return (time_us < limit_us) | same
