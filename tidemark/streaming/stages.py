"""State of one key: open buckets, and what carries over between emitted buckets.

Both stages work on whole Arrow batches. Per-row work is done by numpy and pandas;
Python loops run over buckets and features only.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

Values = dict[str, float | None]
Cell = tuple[int, str]
ARRIVAL = ["arrival_us", "tie"]
STAGED = ["bucket_ms", "feature", "ts_us", "value", "is_member"]
OPENED = ""
NOTHING = (0.0, 0, 0, 0.0)

# Pages of open buckets to a watermark.
PAGES = 128

# Rows of a key that are sorted and taken in at once, and those read at once from a sorted run.
RUN_ROWS = 1 << 18
BLOCK_ROWS = 1 << 12

KINDS = {"feature": pa.string(), "value": pa.float64(), "is_member": pa.bool_()}
SETTINGS = ("watermark_ms", "timeout_ms", "layout")


def parse_layout(layout: str) -> dict[str, bool]:
    """Feature -> whether it takes the latest value, from ``"f1=false,f2=true"``."""
    pairs = (entry.rsplit("=", 1) for entry in layout.split(",") if entry)
    return {feature: latest == "true" for feature, latest in pairs}


def in_arrival_order(batches: list[pd.DataFrame], names: list[str]) -> dict[str, np.ndarray]:
    """Columns of all batches as arrays, rows in arrival order.

    Plain arrays: with many keys a group holds few rows, and the fixed cost of data
    frame operations would exceed the work.
    """
    arrays = {n: np.concatenate([b[n].to_numpy() for b in batches]) for n in [*names, *ARRIVAL]}
    order = np.lexsort([arrays[name] for name in reversed(ARRIVAL)])
    return {name: arrays[name][order] for name in names}


class InArrivalOrder:
    """One micro-batch of a key: its settings, as its last row has them, and its rows in arrival order.

    A batch of more than ``run_rows`` rows is never held whole: its sorted runs wait in a file of the
    task's, and their blocks come back in the order of their first arrivals.
    """

    def __init__(self, batches: Iterable[pd.DataFrame], names: list[str], run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS):
        self.names, self.run_rows, self.block_rows = names, run_rows, block_rows
        self.file = None
        # Of each block in the file: its first arrival and its number.
        self.starts: list[tuple[float, float, int]] = []
        held: list[pd.DataFrame] = []
        n_held = 0
        for batch in batches:
            last = batch
            held.append(batch)
            n_held += len(batch)
            if n_held >= run_rows:
                self._write(held)
                held, n_held = [], 0
        self.watermark, self.timeout = (int(last[n].iat[-1]) for n in SETTINGS[:2])
        self.layout = last[SETTINGS[2]].iat[-1]
        if held and self.file is not None:
            self._write(held)
            held = []
        self.held = held

    def _write(self, batches: list[pd.DataFrame]) -> None:
        rows = in_arrival_order(batches, list(dict.fromkeys([*self.names, *ARRIVAL])))
        run = pa.table({n: pa.array(x, KINDS.get(n, pa.int64()), from_pandas=True) for n, x in rows.items()})
        if self.file is None:
            self.file = tempfile.TemporaryFile()
            self.out = pa.ipc.new_file(self.file, run.schema)
        for at in range(0, len(run), self.block_rows):
            first = (run[n][at].as_py() for n in ARRIVAL)
            self.starts.append((*(np.inf if x is None else x for x in first), len(self.starts)))
        self.out.write_table(run.combine_chunks(), max_chunksize=self.block_rows)

    def chunks(self) -> Iterator[dict[str, np.ndarray]]:
        """The columns as arrays, in parts that follow each other in arrival order."""
        if self.file is None:
            yield in_arrival_order(self.held, self.names)
            return
        self.out.close()
        blocks = pa.ipc.open_file(self.file)
        self.starts.sort()
        waiting: list[pd.DataFrame] = []
        n_new = 0
        for i, (*_, number) in enumerate(self.starts, 1):
            block = blocks.get_batch(number)
            waiting.append(pd.DataFrame({n: block[n].to_numpy(zero_copy_only=False) for n in block.schema.names}))
            n_new += len(block)
            if i < len(self.starts) and n_new < self.run_rows:
                continue
            rows = in_arrival_order(waiting, waiting[0].columns.to_list())
            done = len(rows[ARRIVAL[0]])
            if i < len(self.starts):  # rows from there on may have others before them
                at, tie = (rows[n] for n in ARRIVAL)
                us, then, _ = self.starts[i]
                done = int(np.count_nonzero((at < us) | ((at == us) & (tie < then))))
            waiting, n_new = [pd.DataFrame({n: x[done:] for n, x in rows.items()})], 0
            if done:
                yield {n: rows[n][:done] for n in self.names}
        self.file.close()


def count_by_bucket(bucket: np.ndarray) -> dict[int, int]:
    found, counts = np.unique(bucket, return_counts=True)
    return dict(zip(found.tolist(), counts.tolist()))


class PagedCells:
    """``(bucket, feature) -> numbers`` in state, by pages of neighbouring buckets.

    A page is one state entry. A batch reads and writes the pages it needs, each once, so its
    cost follows the buckets it touches and closes and not those that are open.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, fields: str):
        self.names = [f.split()[0] for f in fields.split(", ") if f]
        lists = [f"{n} array<{t}>" for n, t in (f.split() for f in fields.split(", ") if f)]
        schema = ", ".join(["buckets array<bigint>", "features array<string>", *lists])
        self.map = handle.getMapState(name, "page bigint", schema)
        self.reads = 0

    @staticmethod
    def _cells(entry) -> dict[Cell, tuple]:
        buckets, features, *lists = entry
        return dict(zip(zip(buckets, features), zip(*lists) if lists else [()] * len(buckets)))

    def read(self, page: int) -> dict[Cell, tuple]:
        self.reads += 1
        entry = self.map.getValue((page,))
        return {} if entry is None else self._cells(entry)

    def read_all(self) -> dict[Cell, tuple]:
        found: dict[Cell, tuple] = {}
        for _, entry in self.map.iterator():
            found.update(self._cells(entry))
        return found

    def write(self, page: int, before: dict[Cell, tuple], cells: dict[Cell, tuple]) -> None:
        """Replace what :meth:`read` gave for the page."""
        if cells == before:
            return
        if not cells:
            self.map.removeKey((page,))
            return
        lists = [list(x) for x in zip(*cells.values())] or [[] for _ in self.names]
        self.map.updateValue((page,), ([b for b, _ in cells], [f for _, f in cells], *lists))


class BucketStage:
    """Accepts rows by the key's own lateness and emits buckets once they close.

    Cells are ``(bucket, feature) -> sum, count, latest time, latest value``; a cell with an
    empty feature name marks a bucket as open. The pages that hold cells are listed in
    ``progress``; their width is set with the key's first rows, ``PAGES`` to a watermark.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self.progress = handle.getValueState(
            "progress",
            "newest_ms bigint, watermark_ms bigint, layout string, page_ms bigint, pages array<bigint>",
        )
        self.open = PagedCells(handle, "open", "total double, n bigint, latest_us bigint, latest double")

    def update(self, batch: InArrivalOrder) -> Iterator[tuple[list[tuple[int, Values]], dict[int, int]]]:
        """Take in one batch; for each part of it closed buckets in order, and late rows per bucket."""
        for rows in batch.chunks():
            emitted, _, late = self.take(rows, batch.watermark, batch.layout)
            yield emitted, count_by_bucket(rows["bucket_ms"][late])

    def take(
        self, rows: dict[str, np.ndarray], watermark: int, layout: str
    ) -> tuple[list[tuple[int, Values]], np.ndarray, np.ndarray]:
        """Take in rows in arrival order: closed buckets, the row that closed each, which rows are late."""
        newest, _, _, page_ms, listed = self.progress.get() or (0, 0, "", max(1, watermark // PAGES), [])
        bucket = rows["bucket_ms"]
        member = rows["is_member"].astype(bool)
        # Late rows never raise the maximum, so it may run over all member rows.
        seen = np.maximum.accumulate(np.r_[newest, np.where(member, bucket, 0)])
        accepted = seen[:-1] - watermark < bucket
        newest = int(seen[-1])
        limit = newest - watermark

        opened = np.unique(bucket[accepted]).tolist()
        kept = accepted & member
        parts = list(self._partials(*(rows[n][kept] for n in ("bucket_ms", "feature", "ts_us", "value"))))
        touched = {b // page_ms for b in opened}
        known = {p: self.open.read(p) for p in sorted(touched | {p for p in listed if p * page_ms <= limit})}
        pages = {p: dict(cells) for p, cells in known.items()}
        for b in opened:
            pages[b // page_ms].setdefault((b, OPENED), NOTHING)
        for cell, part in parts:
            page = pages[cell[0] // page_ms]
            page[cell] = self._merge(page.get(cell), part)

        due = {cell: entry for cells in pages.values() for cell, entry in cells.items() if cell[0] <= limit}
        closed = sorted({b for b, _ in due})
        emitted = [(b, self._values(due, b, layout)) for b in closed]
        left = set(listed)
        for p, cells in pages.items():
            rest = {cell: entry for cell, entry in cells.items() if cell[0] > limit}
            self.open.write(p, known[p], rest)
            left = left | {p} if rest else left - {p}
        self.progress.update((newest, watermark, layout, page_ms, sorted(left)))
        closers = np.searchsorted(seen[1:], np.array(closed, np.int64) + watermark)
        return emitted, closers, ~accepted

    def restore(self, newest: int, watermark: int, layout: str, cells: dict[Cell, tuple]) -> None:
        """Add open cells that another query has left."""
        _, _, _, page_ms, listed = self.progress.get() or (0, 0, "", max(1, watermark // PAGES), [])
        pages: dict[int, dict[Cell, tuple]] = {}
        for cell, entry in cells.items():
            pages.setdefault(cell[0] // page_ms, {})[cell] = entry
        for page, new in pages.items():
            known = self.open.read(page)
            self.open.write(page, known, known | new)
        self.progress.update((newest, watermark, layout, page_ms, sorted({*listed, *pages})))

    def flush(self) -> list[tuple[int, Values]]:
        """Emit every open bucket in order and forget the key."""
        progress = self.progress.get()
        if progress is None:
            return []
        known = self.open.read_all()
        emitted = [(b, self._values(known, b, progress[2])) for b in sorted({b for b, _ in known})]
        self.open.map.clear()
        self.progress.clear()
        return emitted

    @staticmethod
    def _partials(bucket: np.ndarray, feature: np.ndarray, ts: np.ndarray, value: np.ndarray):
        """Sum, count and latest value per (bucket, feature); rows come in arrival order."""
        if not len(bucket):
            return
        names, code = np.unique(feature.astype(str), return_inverse=True)
        # The sort is stable: of equal event times the first arrival leads its cell.
        order = np.lexsort([-ts, code, bucket])
        b, c, v = bucket[order], code[order], value[order]
        start = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        totals = np.add.reduceat(v, start)
        counts = np.diff(np.r_[start, len(v)])
        for at, total, n in zip(start, totals, counts):
            cell = (int(b[at]), str(names[c[at]]))
            yield cell, (float(total), int(n), int(ts[order[at]]), float(v[at]))

    @staticmethod
    def _merge(old: tuple | None, new: tuple) -> tuple:
        if old is None:
            return new
        keep = old if new[2] <= old[2] else new
        return (old[0] + new[0], old[1] + new[1], keep[2], keep[3])

    @staticmethod
    def _values(cells: dict, bucket: int, layout: str) -> Values:
        values: Values = {}
        for feature, latest in parse_layout(layout).items():
            cell = cells.get((bucket, feature))
            values[feature] = None if cell is None else cell[3] if latest else cell[0] / cell[1]
        return values


class CarryStage:
    """Numbers emitted buckets and fills gaps with each feature's last known value."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.next_index = handle.getValueState("next_index", "next_index int")
        self.last = handle.getMapState("last", "feature string", "value double")

    def apply(self, buckets: list[tuple[int, Values]]) -> list[tuple[int, int, Values]]:
        """``(bucket, index, filled values)``; buckets come in ascending order."""
        if not buckets:
            return []
        index = (self.next_index.get() or (0,))[0]
        before = {e[0][0]: e[1][0] for e in self.last.iterator()}
        last = dict(before)
        out = []
        for bucket, values in buckets:
            last.update({f: v for f, v in values.items() if v is not None})
            out.append((bucket, index, {f: last.get(f) for f in values}))
            index += 1
        self.next_index.update((index,))
        for feature, value in last.items():
            if before.get(feature) != value:
                self.last.updateValue((feature,), (value,))
        return out

    def restore(self, next_index: int | None, last: dict[str, float]) -> None:
        """Go on where another query has stopped."""
        if next_index is not None:
            self.next_index.update((next_index,))
        for feature, value in last.items():
            self.last.updateValue((feature,), (value,))

    def clear(self) -> None:
        self.next_index.clear()
        self.last.clear()


class Alarm:
    """One re-armable inactivity timer; its expiry is kept in state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.handle = handle
        self.expiry = handle.getValueState(name, "at_ms bigint")

    def set(self, at_ms: int, others: set[int]) -> None:
        """Move the alarm. A timer another alarm also waits for is left in place."""
        old = self.at()
        if old == at_ms:
            return
        if old is not None and old not in others:
            self.handle.deleteTimer(old)
        if at_ms not in others:
            self.handle.registerTimer(at_ms)
        self.expiry.update((at_ms,))

    def at(self) -> int | None:
        return (self.expiry.get() or (None,))[0]

    def clear(self) -> None:
        self.expiry.clear()
