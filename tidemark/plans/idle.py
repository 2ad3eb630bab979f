"""Jobs over a finite table in which quiet keys time out, as they would in a running stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.config import KeySettings, VectorSettings
from tidemark.operators.aggregate import by_setting
from tidemark.operators.enrich import enrich_keyed, enrich_vectors
from tidemark.operators.epochs import (
    EMISSION,
    Epochs,
    IdleClock,
    by_epoch,
    emitted_by_epoch,
    find_epochs,
    number_runs,
    plain_key,
    with_runs,
)
from tidemark.operators.lateness import Closings, accepted_rows, closing_points, judge
from tidemark.operators.scan import SEGMENT_BUCKETS, last_known, running
from tidemark.operators.vectors import assemble
from tidemark.session import materialise


def _first_pass(
    rows: DataFrame, clock: IdleClock, only_member_buckets: bool, segment_buckets: int
) -> tuple[DataFrame, Epochs, Closings]:
    epochs = find_epochs(rows, clock, segment_buckets)
    split = by_epoch(rows, epochs)
    return split, epochs, closing_points(split, only_member_buckets, segment_buckets)


@dataclass(frozen=True)
class IdleKeyedJob:
    """The one-value job with timeouts on the clock of arrivals.

    Gives the rows that the stream with the same clock gives, however the arrivals are cut
    into batches. ``flush`` also emits what is open in the end.
    """

    settings: KeySettings
    clock: IdleClock = field(default_factory=IdleClock)
    flush: bool = False
    segment_buckets: int = SEGMENT_BUCKETS

    def _emitted(self, readings: DataFrame) -> tuple[DataFrame, Epochs]:
        rows, epochs, closings = _first_pass(
            enrich_keyed(readings, self.settings), self.clock, False, self.segment_buckets
        )
        values = plain_key(by_setting(accepted_rows(judge(rows, closings)), ["key", "bucket_ms"]))
        emitted = emitted_by_epoch(closings, epochs, self.flush)
        return emitted.join(values.drop("n_rows"), ["key", "epoch", "bucket_ms"]), epochs

    def buckets(self, readings: DataFrame) -> DataFrame:
        """``key, epoch, bucket_ms, emit_reason, emitted_ms, value``; a bucket comes once per epoch."""
        return self._emitted(readings)[0]

    def numbered(self, readings: DataFrame) -> DataFrame:
        """Adds ``run`` and ``bucket_index``, which start anew after a pause of the output."""
        emitted, epochs = self._emitted(readings)
        if epochs.segments.count > 1:
            emitted = materialise(emitted, "emitted")
        runs = with_runs(emitted, self.clock, epochs.segments)
        if epochs.segments.count > 1:
            runs = materialise(runs, "runs")
        return number_runs(runs, epochs.segments)


@dataclass(frozen=True)
class IdleVectorJob:
    """The vector job with timeouts on the clock of arrivals."""

    settings: VectorSettings
    clock: IdleClock = field(default_factory=IdleClock)
    flush: bool = False
    only_member_buckets: bool = False
    segment_buckets: int = SEGMENT_BUCKETS

    def filled(self, readings: DataFrame) -> DataFrame:
        """Long form: ``key, epoch, bucket_ms, feature, run, bucket_index, value, filled, emit_reason, emitted_ms``.

        Known values are carried within a run only.
        """
        enriched = enrich_vectors(readings, self.settings)
        if self.only_member_buckets:  # foreign readings are no sign of life either
            enriched = enriched.where("is_member")
        rows, epochs, closings = _first_pass(
            enriched, self.clock, self.only_member_buckets, self.segment_buckets
        )
        members = accepted_rows(judge(rows.where("is_member"), closings))
        values = plain_key(by_setting(members, ["key", "bucket_ms", "feature"]))
        segments = epochs.segments
        emitted = emitted_by_epoch(closings, epochs, self.flush)
        if segments.count > 1:
            emitted = materialise(emitted, "emitted")
        runs = with_runs(emitted, self.clock, segments)
        if segments.count > 1:
            runs = materialise(runs, "runs")
        cells = assemble(number_runs(runs, segments), values, self.settings.members, also=("epoch",))
        if segments.count > 1:
            cells = materialise(cells, "cells")
        return running(
            cells, ["key", "run", "feature"], EMISSION, segments, last_known("value", *EMISSION), "filled"
        )
