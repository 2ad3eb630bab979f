"""Progress reports of running queries."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


def end_offsets(text: str | None) -> list[tuple[str, int, int]]:
    """``(topic, partition, offset)`` of a Kafka end-offset text; empty for other sources."""
    try:
        topics = json.loads(text or "")
        return sorted(
            (topic, int(partition), int(offset))
            for topic, partitions in topics.items()
            for partition, offset in partitions.items()
        )
    except (ValueError, AttributeError, TypeError):
        return []


def _log(query: str, batch: int, offsets: list[tuple[str, int, int]]) -> None:
    for topic, partition, offset in offsets:
        log.info("query %s batch %s: %s/%s at offset %s", query, batch, topic, partition, offset)


class OffsetListener(StreamingQueryListener):
    """Reports the end offsets of every source after each batch."""

    def __init__(self, report: Callable[[str, int, list[tuple[str, int, int]]], None] = _log):
        self.report = report

    def onQueryStarted(self, event) -> None:
        log.info("query %s started", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for source in progress.sources:
            self.report(progress.name or str(progress.id), progress.batchId, end_offsets(source.endOffset))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
