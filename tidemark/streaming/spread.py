"""Streaming form for keys too busy for one task.

The fused form handles all rows of a key in one task. Here only *marks* meet per
key: the first arrival of each (key, bucket), combined before the shuffle, so a
handful of rows however busy the key is. They decide where each bucket closes.
The readings themselves are spread over (key, salt) and told the closing points in
the same micro-batch:

    marks    -> per key:       closing points, buckets to emit
    readings -> per key, salt: accept, add up, hand over when told
    parts    -> per key:       merge salts, number, fill

It costs three stateful steps, and up to ``salts`` times the state entries; use it
when one key holds a large share of the rows, and the fused form otherwise.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.processors import CLEANUP_MS, NUMBERED_ROWS, _late_frame, _numbered_frame
from tidemark.streaming.stages import ARRIVAL, OPENED, PAGES, Alarm, CarryStage, PagedCells, Values, parse_layout

SALTS = 8

MARK_ROWS = (
    "key string, bucket_ms bigint, is_member boolean, arrival_us bigint, tie bigint, "
    "watermark_ms bigint, timeout_ms bigint, layout string"
)
ROUTED_ROWS = (
    "key string, salt int, kind string, bucket_ms bigint, feature string, ts_us bigint, "
    "value double, arrival_us bigint, tie bigint, layout string"
)
PART_ROWS = (
    "key string, bucket_ms bigint, feature string, kind string, total double, n bigint, "
    "ts_us bigint, arrival_us bigint, tie bigint, value double, layout string"
)
ROW, CUT, CLOSED, TIMEOUT, LATE, PART = "row", "cut", "closed", "timeout", "late", "part"
ALWAYS_LATE = (-(2**63), 0)
NOTHING = (0.0, 0, 0, 0, 0, 0.0)

Arrival = tuple[int, int]


def combine_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First arrival per (key, bucket), of member and of foreign readings, before the shuffle."""
    for batch in batches:
        if len(batch):
            first = batch.sort_values(ARRIVAL, kind="stable")
            yield first.drop_duplicates(["key", "bucket_ms", "is_member"])


class ClosingProcessor(StatefulProcessor):
    """Per key: where buckets close, which are open, and when to emit them."""

    def __init__(self, salts: int, timers: bool):
        self.salts, self.timers = salts, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState(
            "progress", "newest_ms bigint, layout string, page_ms bigint, pages array<bigint>"
        )
        self.open = PagedCells(handle, "open", "")
        self.alarm = Alarm(handle, "flush_at")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        marks = pd.concat(list(rows), ignore_index=True)
        watermark, layout = int(marks["watermark_ms"].iloc[-1]), marks["layout"].iloc[-1]
        newest, _, page_ms, listed = self.progress.get() or (0, "", max(1, watermark // PAGES), [])
        if self.timers:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.alarm.set(now + int(marks["timeout_ms"].iloc[-1]), set())

        first = marks.sort_values(ARRIVAL, kind="stable").drop_duplicates(["bucket_ms", "is_member"])
        seen = self._arrivals(first)
        member = self._arrivals(first[first["is_member"]])
        limit = newest - watermark
        cuts: dict[int, Arrival] = {}
        # First arrival of any member bucket at or beyond each position.
        ahead = sorted(member)
        closing_from = list(accumulate((member[b] for b in reversed(ahead)), min))[::-1]
        opened = set()
        for bucket, arrived in seen.items():
            at = bisect_left(ahead, bucket + watermark)
            closing = closing_from[at] if at < len(ahead) else None
            if bucket <= limit:
                closing = ALWAYS_LATE
            if closing is None or arrived < closing:
                opened.add(bucket)
            if closing is not None:
                cuts[bucket] = closing
        newest = max([newest, *member])
        limit = newest - watermark

        pages: dict[int, set[int]] = {p: set() for p in listed if p * page_ms <= limit}
        for bucket in opened:
            pages.setdefault(bucket // page_ms, set()).add(bucket)
        due, left = [], set(listed)
        for page, new in pages.items():
            known = self.open.read(page)
            cells = known | {(b, OPENED): () for b in new}
            due += [b for b, _ in cells if b <= limit]
            rest = {cell: () for cell in cells if cell[0] > limit}
            self.open.write(page, known, rest)
            left = left | {page} if rest else left - {page}
        due.sort()
        self.progress.update((newest, layout, page_ms, sorted(left)))
        out = self._orders(key[0], layout, cuts, due, CLOSED)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        if not self.progress.exists():
            return
        layout = self.progress.get()[1]
        due = sorted(b for b, _ in self.open.read_all())
        self.open.map.clear()
        self.progress.clear()
        out = self._orders(key[0], layout, {}, due, TIMEOUT)
        if len(out):
            yield out

    def close(self) -> None:
        pass

    @staticmethod
    def _arrivals(marks: pd.DataFrame) -> dict[int, Arrival]:
        """First arrival per bucket; ``marks`` come in arrival order."""
        once = marks.drop_duplicates("bucket_ms")
        return {int(b): (int(u), int(t)) for b, u, t in zip(once["bucket_ms"], *(once[a] for a in ARRIVAL))}

    def _orders(
        self, key: str, layout: str, cuts: dict[int, Arrival], due: list[int], reason: str
    ) -> pd.DataFrame:
        """Closing points and emit orders for every salt."""
        told = [(CUT, b, *cut, None) for b, cut in cuts.items()]
        told += [(reason, b, 0, 0, layout) for b in due]
        rows = [
            (key, salt, kind, b, OPENED, 0, 0.0, us, tie, text)
            for salt in range(self.salts)
            for kind, b, us, tie, text in told
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ROUTED_ROWS.split(", ")])


class PartProcessor(StatefulProcessor):
    """Per (key, salt): adds up accepted readings until told to hand over.

    Every bucket is a page of its own: a batch reads those it has rows or orders for.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = PagedCells(
            handle, "cells", "total double, n bigint, ts_us bigint, arrival_us bigint, tie bigint, value double"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        told = batch[batch["kind"] != ROW]
        data = batch[batch["kind"] == ROW]
        cuts = told[told["kind"] == CUT].set_index("bucket_ms")[ARRIVAL]
        due = {r.bucket_ms: (r.kind, r.layout) for r in told[told["kind"] != CUT].itertuples()}

        late = pd.Series(dtype="int64")
        if len(cuts):
            concerned = data[data["bucket_ms"].isin(cuts.index)]
            limits = cuts.loc[concerned["bucket_ms"]]
            us, limit_us = (t["arrival_us"].to_numpy() for t in (concerned, limits))
            tie, limit_tie = (t["tie"].to_numpy() for t in (concerned, limits))
            is_late = (us > limit_us) | ((us == limit_us) & (tie > limit_tie))
            late = concerned[is_late].groupby("bucket_ms").size()
            data = data.drop(concerned.index[is_late])

        parts: dict[int, dict] = {b: {} for b in due}
        for cell, part in summed(data[data["feature"] != OPENED]):
            parts.setdefault(cell[0], {})[cell] = part
        out = []
        for bucket, new in parts.items():
            known = self.cells.read(bucket)
            cells = known | {cell: merge_parts(known.get(cell), part) for cell, part in new.items()}
            if bucket in due:
                out += [(key[0], *cell, PART, *entry, None) for cell, entry in cells.items()]
                cells = {}
            self.cells.write(bucket, known, cells)
        if int(key[1]) == 0:
            out += [(key[0], b, OPENED, kind, *NOTHING, text) for b, (kind, text) in due.items()]
        out += [(key[0], b, OPENED, LATE, 0.0, n, *NOTHING[2:], None) for b, n in late.items()]
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PART_ROWS.split(", ")])

    def close(self) -> None:
        pass


def summed(rows: pd.DataFrame) -> Iterator[tuple[tuple[int, str], tuple]]:
    """Sum, count and latest reading per (bucket, feature); of equal times the first arrival."""
    by = ["bucket_ms", "feature"]
    order = rows.sort_values(["ts_us", *ARRIVAL], ascending=[False, True, True], kind="stable")
    groups = order.groupby(by, sort=False)
    sums = groups["value"].agg(total="sum", n="count")
    newest = groups[["ts_us", *ARRIVAL, "value"]].first()
    for cell, total, n, ts, us, tie, value in sums.join(newest).itertuples():
        yield (int(cell[0]), cell[1]), (float(total), int(n), int(ts), int(us), int(tie), float(value))


def merge_parts(left: tuple | None, right: tuple) -> tuple:
    if left is None:
        return right
    newer = min(left, right, key=lambda cell: (-cell[2], cell[3], cell[4]))
    return (left[0] + right[0], left[1] + right[1], *newer[2:])


class JoinUpProcessor(StatefulProcessor):
    """Per key: merges the parts of emitted buckets, numbers them and fills gaps."""

    def __init__(self, timers: bool, report_late: bool, cleanup_ms: int):
        self.timers, self.report_late, self.cleanup_ms = timers, report_late, cleanup_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = CarryStage(handle)
        self.cleanup_alarm = Alarm(handle, "cleanup_at")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts: dict[tuple[int, str], tuple] = {}
        due: dict[int, tuple[str, str]] = {}
        late: dict[int, int] = {}
        for chunk in rows:
            for r in chunk.itertuples():
                if r.kind == LATE:
                    late[r.bucket_ms] = late.get(r.bucket_ms, 0) + int(r.n)
                elif r.kind == PART:
                    cell = (r.total, int(r.n), int(r.ts_us), int(r.arrival_us), int(r.tie), r.value)
                    at = (r.bucket_ms, r.feature)
                    parts[at] = merge_parts(parts.get(at), cell)
                else:
                    due[r.bucket_ms] = (r.kind, r.layout)
        if due:
            buckets = [(b, self._values(parts, b, due[b][1])) for b in sorted(due)]
            if self.timers:
                now = timerValues.getCurrentProcessingTimeInMs()
                self.cleanup_alarm.set(now + self.cleanup_ms, set())
            frame = _numbered_frame(key[0], buckets, self.carry, CLOSED)
            frame["emit_reason"] = [due[b][0] for b in sorted(due)]
            yield frame
        if late and self.report_late:
            yield _late_frame(key[0], late, numbered=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.cleanup_alarm.clear()
        self.carry.clear()
        return iter([])

    def close(self) -> None:
        pass

    @staticmethod
    def _values(parts: dict, bucket: int, layout: str) -> Values:
        values: Values = {}
        for feature, latest in parse_layout(layout).items():
            cell = parts.get((bucket, feature))
            values[feature] = None if cell is None else cell[5] if latest else cell[0] / cell[1]
        return values


def spread(
    rows: DataFrame,
    timers: bool = True,
    report_late: bool = False,
    cleanup_ms: int = CLEANUP_MS,
    salts: int = SALTS,
) -> DataFrame:
    """The rows of the fused form, with the readings of a key worked on by many tasks."""
    mode = "ProcessingTime" if timers else "None"
    marks = rows.select(
        "key", "bucket_ms", "is_member", *ARRIVAL, "watermark_ms", "timeout_ms", "layout"
    ).mapInPandas(combine_marks, MARK_ROWS)
    orders = marks.groupBy("key").transformWithStateInPandas(
        ClosingProcessor(salts, timers), ROUTED_ROWS, "append", mode
    )
    # Foreign readings matter here only as late ones.
    counted = rows if report_late else rows.where("is_member")
    routed = counted.select(
        "key",
        F.pmod(F.xxhash64(*ARRIVAL), F.lit(salts)).cast("int").alias("salt"),
        F.lit(ROW).alias("kind"),
        "bucket_ms",
        F.when(F.col("is_member"), F.col("feature")).otherwise(F.lit(OPENED)).alias("feature"),
        "ts_us",
        "value",
        *ARRIVAL,
        F.lit(None).cast("string").alias("layout"),
    )
    parts = (
        routed.unionByName(orders)
        .groupBy("key", "salt")
        .transformWithStateInPandas(PartProcessor(), PART_ROWS, "append", mode)
    )
    return parts.groupBy("key").transformWithStateInPandas(
        JoinUpProcessor(timers, report_late, cleanup_ms), NUMBERED_ROWS, "append", mode
    )
