"""Near duplicates by SimHash, with a tiled exact comparison of all fingerprints.

*Fingerprints.* A text's words (A-Z lower-cased) make shingles of ``SHINGLE`` words; every
bit of the fingerprint is the majority over the XXH64 values of all shingles.

*Comparison.* Equal fingerprints are one. The distinct ones are dealt to tiles by their
*population counts*, one for each 16-bit quarter. Two fingerprints within the radius differ
in no more set bits than the radius, quarters added up, so only tile pairs whose counts lie
that close are compared, each pair once: with numpy's exclusive-or and bit counts, block
against block. Nothing is approximate, and nothing is skipped but pairs that cannot link.
Tiles of more than ``TILE`` members are cut into sub-tiles, compared with each other as
other tiles are, so no task holds more than one sub-tile and one block of visitors.

*Links.* Within a tile pair the links are thinned to a spanning forest, which keeps
components as they are; those are found by :mod:`components`.

The work is quadratic in the members of neighbouring tiles: with quarters about 1.6 % of
all pairs are compared. ``parts=8`` compares 0.04 % at the price of 73 instead of 21 copies
of each fingerprint in the shuffle; results are the same.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any
other; a null ``doc_id`` is no candidate for the smallest id of its component unless all
are null; rows that repeat are rows of their own; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.components import components
from tidemark.session import materialise

SHINGLE = 3
SEED = 42
RADIUS = 2
PARTS = 4
TILE = 4096
BITS = 64

# Pairs compared by one numpy call.
PAIRS = 1 << 20


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 values of a text's shingles in their order; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    if not text.split():
        return 0
    hashes = shingle_hashes(text, shingle, seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, body (hash of the text) and fp (the 64 bits as a signed number) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "body", "fp"]
            )

    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("body"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, body bigint, fp bigint")


def _counts(fp: Column, parts: int) -> list[Column]:
    width = BITS // parts
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask).cast("long"))) for i in range(parts)]


def _number(counts: list[Column], parts: int) -> Column:
    """Population counts as one number; a count takes 0 to BITS / parts."""
    total = F.lit(0).cast("long")
    for count in counts:
        total = total * (BITS // parts + 1) + count
    return total


def neighbour_offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that links can have, one of each pair of opposites, without none."""
    if parts == 0:
        return []
    reach = range(-radius, radius + 1)
    found: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        found = [(*f, d) for f, d in product(found, reach) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if f > (0,) * parts]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as ``a``-``b`` do, at most one for each node."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both blocks whose values differ in at most ``radius`` bits."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        found.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile_rows: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (column ``fp``), thinned within each tile pair."""
    counts = F.array(*_counts(F.col("fp"), parts))
    tiled = distinct.select("fp", counts.alias("counts"), _number(_counts(F.col("fp"), parts), parts).alias("tile"))
    # At most (BITS / parts + 1) ** parts tiles: 83,521 for quarters.
    subs = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("subs"))
    sub = F.pmod(F.xxhash64("fp"), F.col("subs").cast("long")).cast("int")
    placed = tiled.join(F.broadcast(subs), "tile").withColumn("sub", sub) if parts <= 4 else tiled.join(
        subs, "tile"
    ).withColumn("sub", sub)
    members = placed.select("tile", "sub", F.lit(0).alias("role"), "fp")
    later = F.explode(F.sequence(F.col("sub") + 1, F.col("subs") - 1))
    same = placed.where("sub < subs - 1").select("tile", later.alias("sub"), F.lit(1).alias("role"), "fp")
    most = BITS // parts
    offsets = F.array(*[F.array(*map(F.lit, d)) for d in neighbour_offsets(parts, radius)])
    moved = placed.select("fp", "counts", F.explode(offsets).alias("d"))
    there = [F.col("counts")[i] + F.col("d")[i] for i in range(parts)]
    inside = F.lit(True)
    for c in there:
        inside = inside & c.between(0, most)
    aimed = moved.where(inside).select(_number(there, parts).alias("tile"), "fp")
    targets = F.broadcast(subs) if parts <= 4 else subs
    visits = aimed.join(targets, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(1).alias("role"), "fp"
    )
    work = members.unionByName(same).unionByName(visits)
    ordered = work.repartition("tile", "sub").sortWithinPartitions("tile", "sub", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            tile, part, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            change = (np.diff(tile) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0)
            cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), len(fp)]
            a, b = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                here, block = (int(tile[s]), int(part[s])), fp[s:e]
                if here != unit:
                    unit, own = here, np.zeros(0, np.uint64)
                i, j = close_pairs(block, own, radius)
                a.append(block[i])
                b.append(own[j])
                if role[s] == 0:
                    i, j = close_pairs(block, block, radius)
                    a.append(block[i[i < j]])
                    b.append(block[j[i < j]])
                    own = np.concatenate((own, block))
            if a and sum(map(len, a)):
                x, y = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"]
                )

    return ordered.mapInArrow(compare, "a bigint, b bigint")


def grouped(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS, tile_rows: int = TILE
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = materialise(fingerprints(docs, shingle).select("doc_id", "fp"), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius, parts, tile_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    named = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(by_print, "fp").select("doc_id", named, "component_id")


def survivors(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row with the smallest id of each root, with all its columns.

    ``rooted`` has ``doc_id``, ``body`` (hash of the text) and ``root`` of every row; rows
    of one text have one root. A null id comes after every other; of rows that repeat the
    id in one component the one with the smallest hash of its text stays, of rows that
    repeat both a single one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body")
    least = rooted.groupBy("root").agg(F.min(order).alias("least"))
    stays = least.select(F.col("least.doc_id").alias("keep_id"), F.col("least.body").alias("keep_body"))
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64(text_or_empty()).alias("body"))
    kept = rows.join(stays, F.expr("doc_id <=> keep_id and body = keep_body"), "left_semi")
    return kept.dropDuplicates(["doc_id", "body"]).select("_row.*")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component of linked fingerprints, chosen by :func:`survivors`."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    roots = components(links(prints.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select("doc_id", "body", F.coalesce("root", "fp").alias("root"))
    return survivors(docs, rooted)
