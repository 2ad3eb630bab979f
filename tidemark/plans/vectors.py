"""Vector job: readings of several devices combined into one vector per bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.config import VectorSettings
from tidemark.operators.aggregate import by_setting
from tidemark.operators.enrich import enrich_vectors
from tidemark.operators.lateness import (
    Closings,
    accepted_rows,
    closing_points,
    emitted_buckets,
    judge,
)
from tidemark.operators.scan import SEGMENT_BUCKETS
from tidemark.operators.vectors import assemble, forward_fill, pack, to_messages
from tidemark.session import materialise


@dataclass(frozen=True)
class VectorJob:
    """Vector job over a finite table of readings.

    Gives the rows the streaming job gives for the same arrivals, however these
    are cut into batches. ``flush`` also emits what is still open at the end;
    ``only_member_buckets`` stops foreign features from opening buckets.
    """

    settings: VectorSettings
    flush: bool = False
    only_member_buckets: bool = False
    segment_buckets: int = SEGMENT_BUCKETS

    def _closings(self, readings: DataFrame) -> tuple[DataFrame, Closings]:
        rows = enrich_vectors(readings, self.settings)
        return rows, closing_points(rows, self.only_member_buckets, self.segment_buckets)

    def judged(self, readings: DataFrame) -> DataFrame:
        """Every row with its ``accepted`` flag."""
        rows, closings = self._closings(readings)
        return judge(rows, closings)

    def _assembled(self, readings: DataFrame) -> tuple[DataFrame, Closings]:
        rows, closings = self._closings(readings)
        members = accepted_rows(judge(rows.where("is_member"), closings))
        values = by_setting(members, ["key", "bucket_ms", "feature"])
        emitted = emitted_buckets(closings, self.flush)
        return assemble(emitted, values, self.settings.members), closings

    def assembled(self, readings: DataFrame) -> DataFrame:
        """Long form before filling: ``(key, bucket_ms, feature, value, emit_reason)``."""
        cells, _ = self._assembled(readings)
        return cells.select("key", "bucket_ms", "feature", "value", "emit_reason")

    def filled(self, readings: DataFrame) -> DataFrame:
        """Long form with ``filled`` added."""
        cells, closings = self._assembled(readings)
        if closings.segments.count > 1:
            # The fill reads the cells twice; do not aggregate the readings twice.
            cells = materialise(cells, "cells")
        return forward_fill(cells, closings.segments)

    def vectors(self, readings: DataFrame) -> DataFrame:
        """``(key, bucket_ms, values, emit_reason)``, one row per vector and bucket."""
        return pack(self.filled(readings))

    def messages(self, readings: DataFrame) -> DataFrame:
        """``(key, value)`` text messages."""
        return to_messages(self.vectors(readings))

