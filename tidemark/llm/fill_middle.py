"""Fill-in-the-middle: texts cut at two line ends and written with the middle last.

*Units.* A text is a row of lines (``[^\\n]*\\n|[^\\n]+``). Its prefix ends after the smaller
and its middle after the larger of two drawn numbers of lines; the rest is the suffix.

*Chunks.* Texts are cut into content-defined chunks: a rolling hash over ``WINDOW`` bytes
ends a chunk where its top bits are zero, so passages that texts share give the same chunks
wherever they stand (``LEAST`` to ``MOST`` bytes, never within a character). What a chunk
adds to its text is summed up once and remembered: line ends, code points, whether it holds
a marker, and its first and last two bytes for markers that straddle a border. The memo of
a worker is keyed by the chunk's bytes, so that a hit is verified on the whole content; it
holds at most ``MEMO`` bytes, then starts over.

*Cuts.* Sums over a text's chunks give its number of lines, its length and whether any marker
occurs. A cut is located by bisection in the running line counts, then within one chunk.

*Draws.* The first four 32-bit numbers of the SHA-256 of ``<seed>:<doc_id>``, so a document
is cut alike in every run, whatever the partitions.

Work is one pass without a shuffle; memory is one batch, its output and the memo.

Defined cases: a null text is empty; empty texts and texts that hold a marker stay plain; a
null ``doc_id`` is drawn for as an empty one (``7:``); rows that repeat get the same result
each; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

SEED = 7
RATE = 100
SUFFIX_FIRST = 50

# The markers, and the forms in which they are written.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

WINDOW = 32
CHUNK_BITS = 10
LEAST = 64
MOST = 1 << 14
MEMO = 32 << 20

# Bytes hashed at once, and bytes of output in one batch.
BLOCK = 1 << 20
BATCH = 32 << 20

OUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"


def _gear() -> np.ndarray:
    """A 32-bit number for each byte."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the ``WINDOW`` bytes that end there (fewer at the start)."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def _candidates(text: bytes) -> Iterator[int]:
    """Ends of content-defined chunks, by content alone and never within a character."""
    for at in range(0, len(text), BLOCK):
        back = min(at, WINDOW - 1)
        data = np.frombuffer(text, np.uint8, min(len(text) - at, BLOCK) + back, at - back)
        ends = np.flatnonzero(rolling(data)[back:] >> np.uint32(32 - CHUNK_BITS) == 0) + at + 1
        for end in ends.tolist():
            if end < len(text) and text[end] & 0xC0 != 0x80:
                yield end


def chunks(text: bytes) -> Iterator[bytes]:
    start = 0
    for end in (*_candidates(text), len(text)):
        while end - start > MOST:
            stop = start + MOST
            while text[stop] & 0xC0 == 0x80 and stop > start + MOST - 4:
                stop -= 1
            yield text[start:stop]
            start = stop
        if end - start >= LEAST or end == len(text) > start:
            yield text[start:end]
            start = end


class Summary(NamedTuple):
    """What a chunk adds to its text."""

    lines: int
    chars: int
    marked: bool
    head: bytes
    tail: bytes


def code_points(part: bytes) -> int:
    data = np.frombuffer(part, np.uint8)
    return len(part) - int(np.count_nonzero(data & 0xC0 == 0x80))


def has_marker(part: bytes) -> bool:
    return PREFIX in part or SUFFIX in part or MIDDLE in part


class Memo:
    """Summaries by content, of bounded size."""

    def __init__(self, most: int = MEMO) -> None:
        self.most, self.size, self.known = most, 0, {}

    def summary(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)  # equal bytes, not equal hashes
        if found is None:
            found = Summary(chunk.count(b"\n"), code_points(chunk), has_marker(chunk), chunk[:2], chunk[-2:])
            if self.size + len(chunk) > self.most:
                self.known, self.size = {}, 0
            self.known[chunk] = found
            self.size += len(chunk)
        return found


class Text:
    """A text by its chunks: sums, and places of line ends."""

    def __init__(self, text: bytes, memo: Memo) -> None:
        self.text = text
        self.parts = list(chunks(text))
        sums = [memo.summary(c) for c in self.parts]
        self.line_ends = list(accumulate((s.lines for s in sums), initial=0))
        self.chars = list(accumulate((s.chars for s in sums), initial=0))
        self.starts = list(accumulate(map(len, self.parts), initial=0))
        self.lines = self.line_ends[-1] + (bool(text) and text[-1] != 10)
        self.marked = any(s.marked for s in sums)
        tail = b""
        for s in sums:
            self.marked = self.marked or has_marker(tail + s.head)
            tail = (tail + s.tail)[-2:]

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` lines."""
        if units == 0:
            return 0, 0
        if units > self.line_ends[-1]:
            return len(self.text), self.chars[-1]
        k = bisect_left(self.line_ends, units) - 1
        chunk = self.parts[k]
        ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10)
        end = int(ends[units - self.line_ends[k] - 1]) + 1
        return self.starts[k] + end, self.chars[k] + code_points(chunk[:end])


def rearranged(text: bytes, draws: list[int], memo: Memo, rate: int, suffix_first: int) -> tuple:
    """Lines, form, code points of prefix and middle, output of one text."""
    whole = Text(text, memo)
    if not text or whole.marked or draws[2] % 100 >= rate:
        return whole.lines, PLAIN, None, None, text
    first, last = sorted(d % (whole.lines + 1) for d in draws[:2])
    (a, a_chars), (b, b_chars) = whole.cut(first), whole.cut(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < suffix_first:
        form, output = SPM, (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, output = PSM, (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return whole.lines, form, a_chars, b_chars - a_chars, b"".join(output)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output (text) of every document.

    Of 100 documents ``rate`` are rearranged, of 100 of these ``suffix_first`` with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            drawn = list(zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True))
            out, first, size = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                out.append(rearranged(text.as_py(), drawn[i], memo, rate, suffix_first))
                size += len(out[-1][-1])
                if size >= BATCH or i == len(batch) - 1:
                    n, form, prefix, middle, output = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, len(out)), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                            pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()),
                        ],
                        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                    )
                    out, first, size = [], i + 1, 0

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"), *draws)
    return rows.mapInArrow(run, OUT).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No marker stands in a rearranged text."""
    part = lambda i: F.element_at(F.split(output, "<[PSM]>", -1), i)
    return (
        F.when(form == PLAIN, output)
        .when(form == PSM, F.concat(part(2), part(4), part(3)))
        .otherwise(F.concat(part(3), part(4), part(2)))
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
