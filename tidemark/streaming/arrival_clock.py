"""Inactivity timeouts of a stream on the clock of arrivals instead of the wall clock.

A key that is quiet for longer than its timeout emits its open buckets and forgets its newest
one. Pauses between readings are seen when the next reading comes, in the same batch or in a
later one; a key that stays quiet is flushed by an event-time timer once the watermark on the
arrivals has passed. Both use the readings' own arrival times, so a run can be replayed: for
readings delivered in arrival order the result does not depend on how they are cut into
batches, and is that of :mod:`tidemark.plans.idle`.

The watermark runs ``delay_ms`` behind the newest arrival. Readings delivered later than that
are dropped by Spark, and counted by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.epochs import IdleClock
from tidemark.streaming.processors import NUMBERED_ROWS
from tidemark.streaming.stages import STAGED, Alarm, BucketStage, CarryStage, InArrivalOrder, Values, count_by_bucket

IDLE_ROWS = f"{NUMBERED_ROWS}, epoch bigint, emitted_ms bigint"

# A bucket on its way out: bucket, values, time of emission, reason, epoch.
Emission = tuple[int, Values, int, str, int]


class ArrivalClockProcessor(StatefulProcessor):
    def __init__(self, cleanup_ms: int, report_late: bool):
        self.cleanup_ms, self.report_late = cleanup_ms, report_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = BucketStage(handle)
        self.carry = CarryStage(handle)
        # Newest arrival of the epoch (null between epochs), last emission, number of the epoch.
        self.clock = handle.getValueState("clock", "last_ms bigint, emitted_ms bigint, epoch bigint")
        self.flush_alarm = Alarm(handle, "flush_at")
        self.cleanup_alarm = Alarm(handle, "cleanup_at")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = InArrivalOrder(rows, [*STAGED, "arrival_us"])
        late: list[tuple[int, int, int]] = []
        for arrays in batch.chunks():
            yield from self._take(key[0], arrays, batch, late)
        self.flush_alarm.set(self.clock.get()[0] + batch.timeout, {self.cleanup_alarm.at()} - {None})
        if late and self.report_late:
            yield _late_rows(key[0], _added(late))

    def _take(
        self, key: str, arrays: dict[str, np.ndarray], batch: InArrivalOrder, late: list[tuple[int, int, int]]
    ) -> Iterator[pd.DataFrame]:
        """Take in a part of a batch; ``late`` gets bucket, late rows and epoch."""
        timeout = batch.timeout
        at = arrays["arrival_us"] // 1000
        last, emitted_ms, epoch = self.clock.get() or (None, None, 0)
        newest = np.maximum.accumulate(np.r_[at[0] if last is None else last, at])
        pauses = np.flatnonzero(at - newest[:-1] > timeout).tolist()

        out: list[Emission] = []
        starts = sorted({0, *pauses})
        for start, stop in zip(starts, [*starts[1:], len(at)]):
            if start in pauses:
                out += [(b, v, int(newest[start]) + timeout, "timeout", epoch) for b, v in self.buckets.flush()]
                epoch += 1
            part = {name: arrays[name][start:stop] for name in STAGED}
            closed, closers, is_late = self.buckets.take(part, batch.watermark, batch.layout)
            out += [(b, v, int(at[start + i]), "closed", epoch) for (b, v), i in zip(closed, closers)]
            late += [(b, n, epoch) for b, n in count_by_bucket(part["bucket_ms"][is_late]).items()]
        yield from self._emit(key, out, emitted_ms, int(newest[-1]), epoch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        last, emitted_ms, epoch = self.clock.get() or (None, None, 0)
        flush_at = self.flush_alarm.at()
        if flush_at is not None and flush_at <= now:
            self.flush_alarm.clear()
            out = [(b, v, flush_at, "timeout", epoch) for b, v in self.buckets.flush()]
            yield from self._emit(key[0], out, emitted_ms, None, epoch + 1)
        # After an emission just now this alarm stands later.
        cleanup_at = self.cleanup_alarm.at()
        if cleanup_at is not None and cleanup_at <= now:
            self.cleanup_alarm.clear()
            self.carry.clear()
            last, _, epoch = self.clock.get()
            self.clock.update((last, None, epoch))

    def _emit(
        self, key: str, out: list[Emission], emitted_ms: int | None, last: int | None, epoch: int
    ) -> Iterator[pd.DataFrame]:
        """Number and fill, anew after each pause of the output, and remember where the clock stands."""
        before = emitted_ms
        runs: list[list[Emission]] = []
        for row in out:
            if emitted_ms is not None and row[2] - emitted_ms > self.cleanup_ms:
                runs.append([])
            elif not runs:
                runs.append([])
            runs[-1].append(row)
            emitted_ms = row[2]
        for i, run in enumerate(runs):
            if i or (before is not None and run[0][2] - before > self.cleanup_ms):
                self.carry.clear()
            done = self.carry.apply([(b, v) for b, v, *_ in run])
            yield pd.DataFrame(
                {
                    "key": key,
                    "bucket_ms": [b for b, *_ in run],
                    "bucket_index": pd.array([i for _, i, _ in done], dtype="Int32"),
                    "values": [v for _, v, *_ in run],
                    "filled": [v for *_, v in done],
                    "emit_reason": [r for *_, r, _ in run],
                    "n_late": pd.array([None] * len(run), dtype="Int64"),
                    "epoch": [e for *_, e in run],
                    "emitted_ms": pd.array([at for _, _, at, *_ in run], dtype="Int64"),
                }
            )
        self.clock.update((last, emitted_ms, epoch))
        if out:
            self.cleanup_alarm.set(emitted_ms + self.cleanup_ms, {self.flush_alarm.at()} - {None})

    def close(self) -> None:
        pass


def _added(late: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One row per bucket and epoch."""
    found: Counter[tuple[int, int]] = Counter()
    for bucket, n, epoch in late:
        found[epoch, bucket] += n
    return [(bucket, n, epoch) for (epoch, bucket), n in sorted(found.items())]


def _late_rows(key: str, late: list[tuple[int, int, int]]) -> pd.DataFrame:
    nothing = [None] * len(late)
    return pd.DataFrame(
        {
            "key": key,
            "bucket_ms": [b for b, _, _ in late],
            "bucket_index": pd.array(nothing, dtype="Int32"),
            "values": nothing,
            "filled": nothing,
            "emit_reason": "late",
            "n_late": pd.array([n for _, n, _ in late], dtype="Int64"),
            "epoch": [e for *_, e in late],
            "emitted_ms": pd.array(nothing, dtype="Int64"),
        }
    )


def arrival_clock(rows: DataFrame, clock: IdleClock, report_late: bool = False) -> DataFrame:
    """Emitted buckets from stream rows with a ``layout``; ``delay_ms`` of the clock must be at least 1."""
    if clock.delay_ms < 1:
        # Spark drops rows at the watermark, and arrivals of one millisecond may be in two batches.
        raise ValueError("a stream's clock needs a delay_ms of 1 or more")
    timed = rows.withColumn("arrived", F.timestamp_micros("arrival_us"))
    return (
        timed.withWatermark("arrived", f"{clock.delay_ms} milliseconds")
        .groupBy("key")
        .transformWithStateInPandas(
            ArrivalClockProcessor(clock.cleanup_ms, report_late), IDLE_ROWS, "append", "EventTime"
        )
    )
