"""Repeated passages by longest-previous-factor arrays over a distributed suffix order.

A passage counts as repeated when ``MIN_LENGTH`` bytes that start at one place also start
at another, in the same document or in any other. All such places are found exactly:

1. *Pieces.* Every window of ``MIN_LENGTH`` bytes has an anchor, the ``ANCHOR`` bytes with
   the smallest hash in it (the leftmost on a tie). It depends on the window's content
   only, so equal windows have equal anchors at equal places. Consecutive windows with one
   anchor make a piece; pieces with different anchors share no window. Only hashes of
   pieces (of the anchor and of the whole content) are shuffled, by anchor. Pieces that agree
   in both are a class. Counting only tells which pieces can have a match: those of a class
   with several, and those whose anchor has several classes.
2. *Suffix order.* The bytes of one piece of each such class are fetched, and enter the order
   twice if the class has several. Tasks collect them to buffers of whole anchor groups and
   sort all their suffixes by prefix doubling; the ranks of all widths give the common prefix
   of neighbours, up to ``MIN_LENGTH`` bytes.
3. *Longest previous factors.* In suffix order, the previous and the next suffix with a
   smaller position give the longest earlier match of each window (and those with a larger
   position the longest later one). Windows whose earlier match has the full length are
   later copies; ``keep="first"`` removes these and keeps the first occurrence,
   ``keep="none"`` also removes windows with a later match, so that no copy stays. What the
   arrays say of a class's first copy holds for its first piece, what they say of the
   second for all its others.

An anchor with more than ``CROWD`` pieces (a common passage) is not gathered: if its pieces are
one class, that is fetched; else they are cut into narrow ranges of windows, with the hash of
all bytes that the range's windows have in common as the new anchor, and judged again. In the
last such round a range is one window, whose anchor is its whole content.

Defined cases: a null text is empty; texts shorter than ``MIN_LENGTH`` lose nothing; of rows
that repeat both id and text the first is the earlier copy; a null ``doc_id`` comes before all
others; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, settings, text_or_empty
from tidemark.session import materialise

MIN_LENGTH = 400
ANCHOR = 128
CROWD = 8192

# Windows of a crowded piece that stay together, by round.
ROUNDS = (32, 1)

# Bytes whose windows are hashed at once, and bytes whose suffixes are sorted at once.
BLOCK = 1 << 17
BUFFER = 1 << 20

PLACE_BITS = 20
NO_ID = -(2**63)

PIECE = "fp bigint, content bigint, doc bigint, body bigint, start bigint, size bigint, step bigint, times bigint"
# Pieces that can have a match; ``lead`` is the first one of its class, which has ``n`` in all.
MEMBER = f"{PIECE}, n bigint, lead boolean"
# Ranges of a class's bytes to go: in its first piece, or (``later``) in the others.
RANGE = "fp bigint, content bigint, later boolean, a bigint, b bigint"

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def keyed(docs: DataFrame) -> DataFrame:
    """Documents by a key that any scan gives again: id (nulls first) and a hash of the text."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("body"),
        text.cast("binary").alias("text"),
    )


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each place on."""
    h = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _M[2]
    width = 8
    while width < ANCHOR:
        left, right = h[:-width], h[width:]
        h = (left ^ (left >> np.uint64(29))) * _M[0] + (right ^ (right >> np.uint64(32))) * _M[1]
        width *= 2
    h ^= h >> np.uint64(31)
    return h * _M[2]


def window_anchors(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the place of its anchor."""
    n_places = length - ANCHOR + 1
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= n_places:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < n_places:
        least = np.minimum(least[: span - n_places], least[n_places - span :])
    return (least & mask).astype(np.int64)


def pieces_of(texts: list[bytes], length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """Pieces of all texts: text number, anchor hash, content hash, start, size, step, times.

    Pieces of equal content that follow each other within a text at equal steps (as in
    periodic text) are one row with ``times`` > 1.
    """
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    block: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if block:
            for store, found in zip(out, _block_pieces(block, length), strict=True):
                store.append(found)
        block.clear()
        size = 0

    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            block.append((number, at, part))
            size += len(part)
            if size >= BLOCK:
                flush()
    flush()
    if not out[0]:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    number, fp, content, start, sizes = (np.concatenate(x) for x in out)
    # Runs of one content at equal, overlapping steps.
    step = np.diff(start, append=0)
    same = np.append((np.diff(number) == 0) & (np.diff(fp) == 0) & (np.diff(content) == 0), False)
    same &= (step > 0) & (step <= sizes)
    even = np.concatenate(([True], step[1:] == step[:-1]))
    joins = same & (even | ~np.concatenate(([False], same[:-1])))
    begins = np.concatenate(([True], ~joins[:-1]))
    first = np.nonzero(begins)[0]
    times = np.diff(np.append(first, len(start)))
    return number[first], fp[first], content[first], start[first], sizes[first], np.where(times > 1, step[first], 0), times


def _block_pieces(block: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    from xxhash import xxh3_64_intdigest as digest

    raw = b"".join(part for _, _, part in block)
    data = np.frombuffer(raw, np.uint8)
    hashes = anchor_hashes(data)
    anchors = window_anchors(hashes, length)
    sizes = np.fromiter((len(part) for _, _, part in block), np.int64, len(block))
    ends = np.cumsum(sizes)
    part_of = np.repeat(np.arange(len(block)), sizes)[: len(anchors)]
    valid = np.arange(len(anchors)) + length <= ends[part_of]
    change = np.ones(len(anchors), bool)
    change[1:] = (anchors[1:] != anchors[:-1]) | (part_of[1:] != part_of[:-1]) | (valid[1:] != valid[:-1])
    first = np.nonzero(change)[0]
    last = np.append(first[1:], len(anchors)) - 1
    first, last = first[valid[first]], last[valid[first]]
    view = memoryview(raw)
    content = [digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
    parts = part_of[first]
    number = np.fromiter((n for n, _, _ in block), np.int64, len(block))[parts]
    offset = np.fromiter((at for _, at, _ in block), np.int64, len(block))[parts]
    return (
        number,
        hashes[anchors[first]].view(np.int64),
        np.array(content, np.uint64).view(np.int64),
        first - (ends - sizes)[parts] + offset,
        last - first + length,
    )


def _table(schema: str, columns: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def pieces(docs: DataFrame, length: int = MIN_LENGTH) -> DataFrame:
    """Hashes of the pieces of all documents (:func:`keyed`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            for at in range(0, len(texts), 1000):
                number, *found = pieces_of(texts[at : at + 1000], length)
                keys = [batch.column(i).take(pa.array(number + at)) for i in (0, 1)]
                yield _table(PIECE, [found[0], found[1], *keys, *found[2:]])

    return docs.select("doc", "body", "text").mapInArrow(run, PIECE)


def previous_smaller(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order the nearest place before it with a smaller position (or -1).

    ``order`` holds positions, ``lcp[i]`` the common prefix of places ``i - 1`` and ``i``.
    Also gives the common prefix with the suffix found. All places jump at once: whatever
    lies between a place and its candidate is larger, so a larger candidate's own candidate
    is the next one to try.
    """
    n = len(order)
    before = np.arange(n) - 1
    common = lcp.copy()
    padded = np.append(order, -1)  # place -1: smaller than all
    while True:
        wrong = np.nonzero(padded[before] > order)[0]
        if not len(wrong):
            return before, np.where(before < 0, 0, common)
        via = before[wrong]
        common[wrong] = np.minimum(common[wrong], common[via])
        before[wrong] = before[via]


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """By place of the suffix order: the longest match that starts at a smaller position."""
    _, left = previous_smaller(order, lcp)
    back = np.concatenate(([0], lcp[:0:-1])) if len(lcp) else lcp
    _, right = previous_smaller(order[::-1], back)
    return np.maximum(left, right[::-1])


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Widths up to ``length``, each with the rank of that many bytes from each place on; equal bytes have equal ranks.

    Prefix doubling. ``data`` ends with at least ``length`` bytes that belong to no window.
    """
    big = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        big = (big << np.uint64(8)) | data[i : len(data) - 7 + i]
    out = [(8, _dense(big))]
    while out[-1][0] < length:
        width, rank = out[-1]
        step = min(width, length - width)
        bits = np.uint64(int(rank.max(initial=0)).bit_length())
        key = (rank[: len(rank) - step].astype(np.uint64) << bits) | rank[step:].astype(np.uint64)
        out.append((width + step, _dense(key)))
    return out


def common_prefixes(order: np.ndarray, data: np.ndarray, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Common prefix of each place of ``order`` with the one before it, at most the widest of ``ranks``."""
    if not len(order):
        return np.zeros(0, np.int64)
    most = ranks[-1][0]
    i, j = order[:-1], order[1:]
    found = np.zeros(len(i), np.int64)
    for width, rank in reversed(ranks):
        try_ = np.flatnonzero(found + width <= most)
        same = rank[i[try_] + found[try_]] == rank[j[try_] + found[try_]]
        found[try_[same]] += width
    # What is left is shorter than the narrowest width.
    rest = np.flatnonzero(found < most)
    while len(rest):
        rest = rest[data[i[rest] + found[rest]] == data[j[rest] + found[rest]]]
        found[rest] += 1
        rest = rest[found[rest] < most]
    return np.concatenate(([0], found))


def _sorted(key: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places by their keys, and the keys in that order.

    A key and its place are sorted as one number where they fit in 64 bits, which is much quicker;
    equal keys are then in order of place, else as ``kind`` of sort has it.
    """
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 64:
        order = np.argsort(key, kind=kind)
        return order, key[order]
    both = np.sort((key.astype(np.uint64) << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)


def _dense(key: np.ndarray) -> np.ndarray:
    order, ranked = _sorted(key)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
    return rank


def factors(contents: list[bytes], length: int, entries: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each window of the pieces (in text order): piece, place, longest earlier and later match (``length`` at most).

    ``entries`` lists the pieces' contents by number, where one content is that of several pieces.
    Its bytes are ranked once; each of its pieces has its own places in the order.
    """
    if entries is None:
        entries = np.arange(len(contents))
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contents) + b"\0" * length, np.uint8)
    n_windows = (sizes - length + 1)[entries]
    piece = np.repeat(np.arange(len(entries)), n_windows)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    ranks = prefix_ranks(data, length)
    at = starts[entries[piece]] + place
    order, _ = _sorted(ranks[-1][1][at], "stable")
    lcp = common_prefixes(at[order], data, ranks)
    earlier, later = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
    earlier[order] = longest_previous_factor(order, lcp)
    later[order] = longest_previous_factor(order.max(initial=0) - order, lcp)
    return piece, place, earlier, later


def repeated_windows(
    contents: list[bytes], length: int, keep: str, entries: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the pieces (in text order) are to go: piece numbers and places in them."""
    piece, place, earlier, later = factors(contents, length, entries)
    gone = earlier >= length
    if keep == "none":
        gone |= later >= length
    return piece[gone], place[gone]


def _judge(batches: Iterator[pa.RecordBatch], keep: str) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by anchor, content and place: those that can have a match."""
    rest: pa.Table | None = None
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
    for batch in _with_end(batches):
        if batch is not None:
            new = pa.Table.from_batches([batch]).cast(schema)
            rest = pa.concat_tables([rest, new]) if rest is not None else new
        if rest is None or not len(rest):
            continue
        fp = rest.column("fp").to_numpy()
        change = np.nonzero(np.diff(fp))[0] + 1
        cut = len(fp) if batch is None else (int(change[-1]) if len(change) else 0)
        if cut:
            yield from _judge_groups(rest.slice(0, cut), keep)
            rest = rest.slice(cut)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _judge_groups(rows: pa.Table, keep: str) -> Iterator[pa.RecordBatch]:
    columns = [c.to_numpy() for c in rows.columns]
    if keep == "first":  # rows of the table that repeat come in where all rows do
        new = np.ones(len(rows), bool)
        new[1:] = np.any([np.diff(c) != 0 for c in columns], axis=0)
        columns = [c[new] for c in columns]
    fp, content, times = columns[0], columns[1], columns[-1]
    new_fp = np.concatenate(([True], np.diff(fp) != 0))
    lead = new_fp | np.concatenate(([True], np.diff(content) != 0))
    class_of = np.cumsum(lead) - 1
    total = np.bincount(class_of, times).astype(np.int64)[class_of]
    n_classes = np.bincount(np.cumsum(new_fp) - 1, lead)[np.cumsum(new_fp) - 1]
    can = (total > 1) | (n_classes > 1)
    yield _table(MEMBER, [*(c[can] for c in columns), total[can], lead[can]])


def with_content(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc, body, a, b and others) with the bytes from a to b of their documents.

    Few documents have such rows. A filter made of their keys is pushed to the scan where
    Spark can, so that the others' texts are not shuffled.
    """
    part = F.expr("substring(text, CAST(a + 1 AS INT), CAST(b - a AS INT))")
    return rows.join(docs.select("doc", "body", "text"), ["doc", "body"]).withColumn("content", part).drop("text")


BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "40000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "134217728",
}


def _sort_suffixes(batches: Iterator[pa.RecordBatch], length: int, keep: str) -> Iterator[pa.RecordBatch]:
    """Ranges of classes to go, from fp, doc, body, a, hash (of the class), n, bytes of their leads, sorted by anchor."""
    rows: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal rows, size
        rows.sort(key=lambda r: r[1:4])
        # A class of several enters twice; what matters of its second copy is that the first one comes before.
        number = np.repeat(np.arange(len(rows)), [1 + (r[5] > 1) for r in rows])
        second = np.diff(number, prepend=-1) == 0
        piece, place = repeated_windows([r[6] for r in rows], length, keep, number)
        if len(piece):
            cut = np.concatenate(([True], (np.diff(piece) != 0) | (np.diff(place) != 1)))
            first = np.nonzero(cut)[0]
            last = np.append(first[1:], len(piece)) - 1
            at = piece[first]
            fp, content = (np.array([r[k] for r in rows], np.int64)[number[at]] for k in (0, 4))
            yield _table(RANGE, [fp, content, second[at], place[first], place[last] + length])
        rows, size = [], 0

    seen: set = set()
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if rows and row[0] != rows[-1][0]:
                seen = set()
                if size >= BUFFER:
                    yield from flush()
            if row[4] in seen:  # a row of the table that repeats
                continue
            seen.add(row[4])
            rows.append(row)
            size += len(row[6])
    if rows:
        yield from flush()


def _narrow(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces cut to ranges of at most ``width`` windows, by the windows' distance from the anchor."""
    from xxhash import xxh3_64_intdigest as digest

    for batch in batches:
        out = []
        for fp, doc, body, a, content in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            data = np.frombuffer(content, np.uint8)
            n = len(content) - length + 1
            hashes = anchor_hashes(data)
            anchor = int(window_anchors(hashes, length)[0])
            view = memoryview(content)
            for far in range((anchor - n + 1) // width, anchor // width + 1):
                # Windows that start ``far * width`` to ``(far + 1) * width - 1`` bytes before the anchor.
                i, j = max(0, anchor - (far + 1) * width + 1), min(n - 1, anchor - far * width)
                core = anchor - far * width
                key = digest(view[core : core - width + 1 + length], far & 0xFFFF) ^ (fp & (2**64 - 1))
                out.append((key, digest(view[i : j + length]), doc, body, a + i, j - i + length))
        fp, content, doc, body, start, size = zip(*out, strict=True) if out else [()] * 6
        signed = [np.array(x, np.uint64).view(np.int64) for x in (fp, content)]
        rest = [np.array(x, np.int64) for x in (doc, body, start, size)]
        yield _table(PIECE, [*signed, *rest, np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64)])


def of_members(members: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc, body, a, b: the ranges of classes, moved to each piece of the class.

    A piece with ``times`` > 1 stands for copies of one content that overlap at equal steps.
    Of a class's lead only the first of these is the first copy.
    """
    both = members.join(ranges, ["fp", "content"])

    def moved(rows: DataFrame, i: Column, j: Column) -> DataFrame:
        at = lambda k: F.col("start") + F.col("step") * k
        return rows.select("doc", "body", (at(i) + F.col("a")).alias("a"), (at(j) + F.col("b")).alias("b"))

    zero, i, last = F.lit(0).cast("bigint"), F.col("lead").cast("bigint"), F.col("times") - 1
    others = both.where("later AND (NOT lead OR times > 1)")
    parts = others.where("NOT (a = 0 AND b = size)").withColumn("i", F.explode(F.sequence(i, last)))
    return (
        moved(both.where("lead AND NOT later"), zero, zero)
        .unionByName(moved(others.where("a = 0 AND b = size"), i, last))
        .unionByName(moved(parts, F.col("i"), F.col("i")))
    )


def spans(docs: DataFrame, length: int = MIN_LENGTH, keep: str = "first", crowd: int = CROWD) -> DataFrame:
    """doc, body, a, b: ranges of bytes to remove (they may overlap) of :func:`keyed` documents."""
    if keep not in ("first", "none"):
        raise ValueError("keep: first or none")

    def class_ranges(leads: DataFrame) -> DataFrame:
        named = ["fp", "doc", "body", F.col("start").alias("a"), F.expr("start + size").alias("b"), F.col("content").alias("hash"), "n"]
        with settings(docs.sparkSession, BLOOM):
            contents = with_content(docs, leads.select(*named)).select("fp", "doc", "body", "a", "hash", "n", "content")
            ordered = contents.repartition("fp").sortWithinPartitions("fp", "doc", "body", "a")
            return materialise(ordered.mapInArrow(lambda b: _sort_suffixes(b, length, keep), RANGE), "ranges")

    rows = materialise(pieces(docs, length), "pieces")
    found: list[DataFrame] = []
    for width in (*ROUNDS, None):
        sums = rows.groupBy("fp").agg(
            F.count(F.lit(1)).alias("rows"), F.min("content").alias("content"), F.max("content").alias("other"),
        )
        crowds = materialise(sums.where(F.col("rows") > crowd), "crowds")
        n_crowds = crowds.count()
        light = rows
        if n_crowds:
            few = n_crowds * 64 <= BROADCAST_BYTES
            crowds = F.broadcast(crowds) if few else crowds
            light = rows.join(crowds, "fp", "left_anti")
        order = ["fp", "content", "doc", "body", "start"]
        members = light.repartition("fp").sortWithinPartitions(*order).mapInArrow(lambda b: _judge(b, keep), MEMBER)
        members = materialise(members, "members")
        found.append(of_members(members, class_ranges(members.where("lead"))))
        if not n_crowds:
            break
        crowded = rows.join(crowds.select("fp", F.col("content").alias("one"), "other"), "fp")
        alike = crowded.where("one = other")
        at = F.struct("doc", "body", "start", "size")
        leads = alike.groupBy("fp", "content").agg(F.min(at).alias("at"), F.sum("times").alias("n"))
        leads = materialise(leads.select("fp", "content", "at.*", "n", "at"), "leads")
        ranges, at_lead = class_ranges(leads), leads.select("fp", "at")
        if few:
            ranges, at_lead = F.broadcast(ranges), F.broadcast(at_lead)
        marked = alike.join(at_lead, "fp").withColumn("lead", at == F.col("at"))
        found.append(of_members(marked, ranges))
        mixed = crowded.where("one <> other")
        if width is None:
            break
        every = F.explode(F.expr("transform(sequence(0L, times - 1), i -> start + i * step)"))
        single = mixed.select("fp", "doc", "body", every.alias("a"), "size").withColumn("b", F.expr("a + size"))
        with settings(docs.sparkSession, BLOOM):
            contents = with_content(docs, single).select("fp", "doc", "body", "a", "content")
            cut = width
            rows = materialise(contents.mapInArrow(lambda b: _narrow(b, cut, length), PIECE), "pieces")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cleaned(docs: DataFrame, length: int = MIN_LENGTH, keep: str = "first", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end in bytes), kept (the bytes left) of every document."""
    rows = keyed(docs)
    gone = spans(rows, length, keep, crowd)
    by_doc = gone.groupBy("doc", "body").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("ranges"))
    if keep == "first":  # of rows that repeat, which are all alike, all but one lose what is long enough
        one = rows.groupBy("doc", "body").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        size = F.octet_length("text").cast("bigint")
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), size.alias("b")))
        both = one.join(by_doc, ["doc", "body"], "left")
        both = both.select("doc_id", "text", "ranges", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
        both = both.select("doc_id", "text", F.when((F.col("copy") > 1) & (size >= length), whole).otherwise(F.col("ranges")).alias("ranges"))
    else:
        both = rows.join(by_doc, ["doc", "body"], "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                sizes.append(len(text))
                runs = merged([(r["a"], r["b"]) for r in ranges or ()])
                ends = [0, *(b for _, b in runs)]
                starts = [*(a for a, _ in runs), len(text)]
                removed.append([{"a": a, "b": b} for a, b in runs])
                kept.append(b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, removed array<struct<a: bigint, b: bigint>>, kept binary")


def digests(docs: DataFrame, length: int = MIN_LENGTH, keep: str = "none", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    lost = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r["b"] - r["a"])
    return cleaned(docs, length, keep, crowd).select(
        "doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
