"""Progress of running queries as a table.

Counts are taken by ``observe`` while a micro-batch runs, so they need no pass of their own, and
come with its progress report. :class:`ProgressLog` turns each report into rows: offsets of every
topic and partition, rows read, and all observed counts.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators.enrich import REJECT, REASONS
from tidemark.streaming.listener import end_offsets

ROWS = "query string, batch_id bigint, at string, source int, topic string, partition int, metric string, value bigint"

OFFSET, READ, REJECTED, EMITTED = "offset", "rows_read", "rejected", "emitted"


def observe_rejects(tagged: DataFrame, name: str = REJECTED) -> DataFrame:
    """Count rejected readings by reason, and those that are fit as ``fit``."""
    reason = F.col(REJECT)
    counts = [F.count_if(reason == r).alias(r) for r in REASONS]
    return tagged.observe(name, *counts, F.count_if(reason.isNull()).alias("fit"))


def observe_emitted(emitted: DataFrame, name: str = EMITTED) -> DataFrame:
    """Count emitted buckets by reason, and late readings of a stream that reports them."""
    reason = F.col("emit_reason")
    counts = [F.count_if(reason == r).alias(r) for r in ("closed", "timeout")]
    return emitted.observe(name, *counts, F.coalesce(F.sum("n_late"), F.lit(0).cast("bigint")).alias("late"))


class ProgressLog(StreamingQueryListener):
    """Rows (see ``ROWS``) of all progress reports since it was added to a session's listeners.

    Reports are small and few (one per query and batch); :meth:`write` moves those so far to a folder.
    """

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.found: list[tuple] = []
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        name = progress.name or str(progress.id)
        head = (name, progress.batchId, progress.timestamp)
        rows = []
        for i, source in enumerate(progress.sources):
            rows += [(*head, i, topic, part, OFFSET, at) for topic, part, at in end_offsets(source.endOffset)]
            rows.append((*head, i, None, None, READ, source.numInputRows))
        for group, counts in progress.observedMetrics.items():
            rows += [(*head, None, group, None, metric, int(n)) for metric, n in counts.asDict().items() if n is not None]
        with self.lock:
            self.found += rows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Until all reports of a query's run have come."""
        if not self._end(str(run_id)).wait(seconds):
            raise TimeoutError(f"no end of run {run_id} was reported")

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows so far. For observed counts ``topic`` is the name they were observed under."""
        with self.lock:
            rows = list(self.found)
        return spark.createDataFrame(rows, ROWS)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append the rows so far to a folder and forget them."""
        with self.lock:
            rows, self.found = self.found, []
        if rows:
            spark.createDataFrame(rows, ROWS).write.mode("append").parquet(path)
