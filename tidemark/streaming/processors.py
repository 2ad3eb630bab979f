"""Stateful processors of the streaming jobs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.stages import ARRIVAL, STAGED, Alarm, BucketStage, CarryStage, InArrivalOrder, Values

CLEANUP_MS = 5 * 60 * 1000

VALUES = "map<string, double>"
BUCKET_ROWS = f"key string, bucket_ms bigint, values {VALUES}, emit_reason string, n_late bigint"
NUMBERED_ROWS = (
    f"key string, bucket_ms bigint, bucket_index int, values {VALUES}, filled {VALUES}, "
    "emit_reason string, n_late bigint"
)
# Kinds of rows that carry a key's state over: a cell of an open bucket, a last value, or neither.
CELL, LAST, KEY = "cell", "last", "key"
INACTIVE_ROWS = "key string, bucket_ms bigint, value double"


def _bucket_frame(key: str, buckets: list[tuple[int, Values]], reason: str) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "key": key,
            "bucket_ms": [b for b, _ in buckets],
            "values": [v for _, v in buckets],
            "emit_reason": reason,
            "n_late": pd.array([None] * len(buckets), dtype="Int64"),
        }
    )


def _numbered_frame(
    key: str, buckets: list[tuple[int, Values]], carry: CarryStage, reason: str
) -> pd.DataFrame:
    done = carry.apply(buckets)
    return pd.DataFrame(
        {
            "key": key,
            "bucket_ms": [b for b, _, _ in done],
            "bucket_index": pd.array([i for _, i, _ in done], dtype="Int32"),
            "values": [v for _, v in buckets],
            "filled": [v for _, _, v in done],
            "emit_reason": reason,
            "n_late": pd.array([None] * len(done), dtype="Int64"),
        }
    )


def _late_frame(key: str, late: dict[int, int], numbered: bool) -> pd.DataFrame:
    """Late rows per bucket; the value columns stay null."""
    nothing = [None] * len(late)
    columns = {"key": key, "bucket_ms": list(late)}
    if numbered:
        columns["bucket_index"] = pd.array(nothing, dtype="Int32")
    columns["values"] = nothing
    if numbered:
        columns["filled"] = nothing
    return pd.DataFrame({**columns, "emit_reason": "late", "n_late": list(late.values())})


class _Timed(StatefulProcessor):
    """Common options: whether to use timers, and whether to report late rows."""

    def __init__(self, timers: bool = True, report_late: bool = False, cleanup_ms: int = CLEANUP_MS):
        self.timers = timers
        self.report_late = report_late
        self.cleanup_ms = cleanup_ms

    def close(self) -> None:
        pass


class FusedProcessor(_Timed):
    """Buckets, numbering and forward fill behind one shuffle.

    Two alarms per key: inactivity flushes the open buckets, a longer inactivity of
    the output forgets index and last values.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = BucketStage(handle)
        self.carry = CarryStage(handle)
        self.flush_alarm = Alarm(handle, "flush_at")
        self.cleanup_alarm = Alarm(handle, "cleanup_at")

    def _arm(self, alarm: Alarm, other: Alarm, at_ms: int) -> None:
        alarm.set(at_ms, {other.at()} - {None})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = InArrivalOrder(rows, STAGED)
        late: Counter[int] = Counter()
        closed = False
        for emitted, more in self.buckets.update(batch):
            late.update(more)
            if emitted:
                closed = True
                yield _numbered_frame(key[0], emitted, self.carry, "closed")
        self._rearm(timerValues, batch.timeout, closed)
        if late and self.report_late:
            yield _late_frame(key[0], dict(sorted(late.items())), numbered=True)

    def _rearm(self, timerValues, timeout_ms: int, emitted: bool) -> None:
        if self.timers:
            now = timerValues.getCurrentProcessingTimeInMs()
            self._arm(self.flush_alarm, self.cleanup_alarm, now + timeout_ms)
            if emitted:
                self._arm(self.cleanup_alarm, self.flush_alarm, now + self.cleanup_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Take over what :func:`tidemark.streaming.state.carried` has read of another query."""
        cells = initialState[initialState["kind"] == CELL]
        names = ["total", "n", "latest_us", "latest"]
        entries = zip(cells["bucket_ms"].astype("int64"), cells["feature"], *(cells[n] for n in names))
        known = initialState["newest_ms"].notna()
        if known.any():
            row = initialState[known].iloc[0]
            self.buckets.restore(
                int(row["newest_ms"]), int(row["watermark_ms"]), row["layout"],
                {(int(b), f): (float(total), int(n), int(us), float(v)) for b, f, total, n, us, v in entries},
            )
        last = initialState[initialState["kind"] == LAST]
        index = initialState["next_index"].dropna()
        self.carry.restore(int(index.iloc[0]) if len(index) else None, dict(zip(last["feature"], last["latest"])))
        if self.timers and known.any():
            now = timerValues.getCurrentProcessingTimeInMs()
            self._arm(self.flush_alarm, self.cleanup_alarm, now + int(row["watermark_ms"]))
            self._arm(self.cleanup_alarm, self.flush_alarm, now + self.cleanup_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        flush_at, cleanup_at = self.flush_alarm.at(), self.cleanup_alarm.at()
        emitted = []
        if expired == flush_at:
            emitted = self.buckets.flush()
            self.flush_alarm.clear()
        if expired == cleanup_at:
            # The timer that has just fired is gone already.
            self.cleanup_alarm.clear()
            if not emitted:
                self.carry.clear()
        if emitted:
            now = timerValues.getCurrentProcessingTimeInMs()
            self._arm(self.cleanup_alarm, self.flush_alarm, now + self.cleanup_ms)
            yield _numbered_frame(key[0], emitted, self.carry, "timeout")


class BucketProcessor(_Timed):
    """First half of the chained form: buckets as they close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = BucketStage(handle)
        self.flush_alarm = Alarm(handle, "flush_at")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = InArrivalOrder(rows, STAGED)
        late: Counter[int] = Counter()
        for emitted, more in self.buckets.update(batch):
            late.update(more)
            if emitted:
                yield _bucket_frame(key[0], emitted, "closed")
        if self.timers:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.flush_alarm.set(now + batch.timeout, set())
        if late and self.report_late:
            yield _late_frame(key[0], dict(sorted(late.items())), numbered=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.flush_alarm.clear()
        emitted = self.buckets.flush()
        if emitted:
            yield _bucket_frame(key[0], emitted, "timeout")


class CarryProcessor(_Timed):
    """Second half of the chained form: numbering and forward fill."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = CarryStage(handle)
        self.cleanup_alarm = Alarm(handle, "cleanup_at")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        late = batch[batch["emit_reason"] == "late"]
        if len(late):
            yield _late_frame(key[0], dict(zip(late["bucket_ms"], late["n_late"])), numbered=True)
        # Buckets that closed come before those flushed in the same batch.
        batch = batch[batch["emit_reason"] != "late"].sort_values("bucket_ms", kind="stable")
        if batch.empty:
            return
        if self.timers:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.cleanup_alarm.set(now + self.cleanup_ms, set())
        buckets = [(int(b), dict(v)) for b, v in zip(batch["bucket_ms"], batch["values"])]
        frame = _numbered_frame(key[0], buckets, self.carry, "")
        frame["emit_reason"] = batch["emit_reason"].to_numpy()
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.cleanup_alarm.clear()
        self.carry.clear()
        return iter([])


def combine_inactive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side partial aggregates per (key, bucket), so that a hot bucket shuffles few rows."""
    order = ["ts_us", *ARRIVAL]
    for batch in batches:
        if batch.empty:
            continue
        by = ["key", "bucket_ms"]
        rows = batch.sort_values(order, kind="stable")
        groups = rows.groupby(by, sort=False)
        sums = groups["value"].agg(total="sum", n="count")
        last = groups[["latest", "timeout_ms", *order, "value"]].last()
        yield sums.join(last).reset_index()


COMBINED_ROWS = (
    "key string, bucket_ms bigint, total double, n bigint, latest boolean, timeout_ms bigint, "
    "ts_us bigint, arrival_us bigint, tie bigint, value double"
)


class InactiveBucketProcessor(StatefulProcessor):
    """State per (key, bucket), emitted only when the bucket has been quiet.

    No row is late; among equal event times the last arrival wins.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState(
            "cell",
            "total double, n bigint, latest boolean, ts_us bigint, arrival_us bigint, tie bigint, "
            "value double",
        )
        self.alarm = Alarm(handle, "flush_at")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order = ["ts_us", *ARRIVAL]
        total, n, best, value = 0.0, 0, None, None
        if self.cell.exists():
            old = self.cell.get()
            total, n, best, value = old[0], old[1], tuple(old[3:6]), old[6]
        for batch in rows:
            total += float(batch["total"].sum())
            n += int(batch["n"].sum())
            last = batch.sort_values(order, kind="stable").iloc[-1]
            rank = tuple(int(last[name]) for name in order)
            if best is None or rank >= best:
                best, value = rank, float(last["value"])
            latest, timeout = bool(last["latest"]), int(last["timeout_ms"])
        self.cell.update((total, n, latest, *best, value))
        self.alarm.set(timerValues.getCurrentProcessingTimeInMs() + timeout, set())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        if not self.cell.exists():
            return
        total, n, latest, *_, value = self.cell.get()
        self.cell.clear()
        yield pd.DataFrame(
            {"key": [key[0]], "bucket_ms": [int(key[1])], "value": [value if latest else total / n]}
        )

    def close(self) -> None:
        pass


def _mode(timers: bool) -> str:
    return "ProcessingTime" if timers else "None"


def fused(
    rows: DataFrame,
    timers: bool = True,
    report_late: bool = False,
    cleanup_ms: int = CLEANUP_MS,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Emitted buckets, numbered and filled, from stream rows with a ``layout``.

    ``initial`` is what :func:`tidemark.streaming.state.carried` has read of an earlier query,
    which may have had other allowances and features. A restored key times out after its old
    watermark, unless rows come before.
    """
    return rows.groupBy("key").transformWithStateInPandas(
        FusedProcessor(timers, report_late, cleanup_ms), NUMBERED_ROWS, "append", _mode(timers),
        initialState=None if initial is None else initial.groupBy("key"),
    )


def chained(
    rows: DataFrame, timers: bool = True, report_late: bool = False, cleanup_ms: int = CLEANUP_MS
) -> DataFrame:
    """The same rows from two stateful steps with a shuffle between them."""
    buckets = rows.groupBy("key").transformWithStateInPandas(
        BucketProcessor(timers, report_late), BUCKET_ROWS, "append", _mode(timers)
    )
    return buckets.groupBy("key").transformWithStateInPandas(
        CarryProcessor(timers, cleanup_ms=cleanup_ms), NUMBERED_ROWS, "append", _mode(timers)
    )


def inactive(rows: DataFrame) -> DataFrame:
    """``(key, bucket_ms, value)`` of buckets that have gone quiet, rows with nulls dropped."""
    partial = rows.select(
        "key", "bucket_ms", "ts_us", *ARRIVAL, "value", "latest", "timeout_ms"
    ).mapInPandas(combine_inactive, COMBINED_ROWS)
    return (
        partial.groupBy("key", "bucket_ms")
        .transformWithStateInPandas(InactiveBucketProcessor(), INACTIVE_ROWS, "append", "ProcessingTime")
        .na.drop()
    )
