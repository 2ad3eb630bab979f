"""Token ids as binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents in blocks of ``BLOCK`` ids::

    block        minimum uint32, width uint8, 0, exceptions uint16,
                 ids minus minimum, ``width`` bits each, lowest bit first, padded to whole bytes,
                 positions of the exceptions uint16 each, their values uint32 each
    documents    doc_id int64, end uint64 (ids of the file up to and with the document)
    block starts uint64 each
    footer       blocks, documents, ids uint64, block size uint64, magic

all little-endian. The width of a block is that of the ``PERCENTILE`` of its differences;
larger ones keep their low bits in place and are patched from the exception list. The
block starts lead a reader to any id without decoding what stands before it.

Documents are range-partitioned by id, each partition encodes and writes one file below a
name of its own and then moves it into place: a task that runs again writes the same
bytes. Only one row per file (its name and counts) comes back to the driver.

Defined cases: a null text is empty (it still gets the end id); a null ``doc_id`` sorts
first and is kept; of rows with equal ids the order is by text; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_or_empty
from tidemark.llm.word_ids import word_ids
from tidemark.session import scratch_path

BLOCK = 512
PERCENTILE = 90
MAGIC = b"TMPFOR01"
FOOTER = struct.Struct("<QQQQ8s")
HEAD = struct.Struct("<IBBH")
NO_ID = -(2**63)

# Blocks whose bits are laid out at once, four bytes for each bit.
BLOCKS_AT_ONCE = 128

# Characters encoded at once.
SLICE_CHARS = 1_000_000


def _widths(values: np.ndarray) -> np.ndarray:
    return np.searchsorted(2 ** np.arange(33, dtype=np.int64), values, side="right").astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of ``BLOCK`` ids (a last one may be shorter)."""
    full = len(ids) // BLOCK * BLOCK
    rows = ids[:full].reshape(-1, BLOCK)
    packed: list[bytes] = []
    for at in range(0, len(rows), BLOCKS_AT_ONCE):
        packed += _pack(rows[at : at + BLOCKS_AT_ONCE].astype(np.int64), percentile)
    if full < len(ids):
        packed += _pack(ids[full:].reshape(1, -1).astype(np.int64), percentile)
    return packed


def _pack(rows: np.ndarray, percentile: int) -> list[bytes]:
    if not rows.size:
        return []
    n = rows.shape[1]
    least = rows.min(axis=1)
    above = rows - least[:, None]
    at = min(n - 1, n * percentile // 100)
    width = _widths(np.partition(above, at, axis=1)[:, at])
    over = above >= (1 << width)[:, None]
    n_over = over.sum(axis=1)
    where = np.nonzero(over)
    positions, values = where[1].astype("<u2").tobytes(), above[where].astype("<u4").tobytes()
    ends = np.cumsum(n_over)
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        chosen = np.nonzero(width == w)[0]
        bits = (above[chosen].astype(np.uint32)[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
        body = np.packbits(bits.astype(np.uint8).reshape(len(chosen), -1), axis=1, bitorder="little")
        for i, row in zip(chosen.tolist(), body, strict=True):
            b, a = int(ends[i]), int(ends[i] - n_over[i])
            out[i] = (
                HEAD.pack(int(least[i]), int(w), 0, b - a)
                + row.tobytes()
                + positions[2 * a : 2 * b]
                + values[4 * a : 4 * b]
            )
    return out


def unpack_block(data: bytes, start: int, n: int) -> np.ndarray:
    """The ``n`` ids of the block that begins at byte ``start``."""
    least, width, _, n_over = HEAD.unpack_from(data, start)
    start += HEAD.size
    n_bytes = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n_bytes, start), count=n * width, bitorder="little")
    ids = bits.reshape(n, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    ids = ids.astype(np.uint32)
    start += n_bytes
    ids[np.frombuffer(data, "<u2", n_over, start)] = np.frombuffer(data, "<u4", n_over, start + 2 * n_over)
    return ids + np.uint32(least)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes the ids of documents into one file."""

    def __init__(self, out, percentile: int = PERCENTILE):
        self.out, self.percentile = out, percentile
        self.rest = np.zeros(0, np.uint16)
        self.starts: list[int] = []
        self.docs: list[np.ndarray] = []
        self.n_ids = self.n_docs = self.at = 0

    def _blocks(self, ids: np.ndarray) -> None:
        for block in pack_blocks(ids, self.percentile):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(np.stack((doc_ids.astype("<i8"), self.n_ids + np.cumsum(counts).astype("<i8"))))
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)
        ids = np.concatenate((self.rest, ids))
        full = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:full])
        self.rest = ids[full:].copy()

    def close(self) -> None:
        self._blocks(self.rest)
        if self.docs:
            self.out.write(np.concatenate(self.docs, axis=1).astype("<i8").tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(FOOTER.pack(len(self.starts), self.n_docs, self.n_ids, BLOCK, MAGIC))


class Reader:
    """Reads a file from its bytes."""

    def __init__(self, data: bytes):
        self.data = data
        n_blocks, n_docs, self.n_ids, self.block, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a token file")
        starts_at = len(data) - FOOTER.size - 8 * n_blocks
        self.starts = np.frombuffer(data, "<u8", n_blocks, starts_at)
        table = np.frombuffer(data, "<i8", 2 * n_docs, starts_at - 16 * n_docs).reshape(2, n_docs)
        self.doc_ids, self.ends = table[0], table[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are decoded."""
        first, last = start // self.block, -(-stop // self.block)
        parts = [
            unpack_block(self.data, int(self.starts[b]), min(self.block, self.n_ids - b * self.block))
            for b in range(first, last)
        ]
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return whole[start - first * self.block : stop - first * self.block]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the ids of ``docs`` below ``folder``; one row (file, start, n_ids, n_docs) per file."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer, end_id, blanks=True)
        store, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        own = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        writer = out = None
        for batch in batches:
            doc_ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in slices(list(map(len, texts)), SLICE_CHARS):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(own)
                    writer = Writer(out)
                writer.add(doc_ids[a:b], *coder.encode(texts[a:b]))
        if writer is None:
            return
        writer.close()
        out.close()
        name = f"part-{part:06d}.pfor"
        store.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [f"{folder}/{name}"], "n_ids": [writer.n_ids], "n_docs": [writer.n_docs]},
            schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]),
        )

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    schema = "part bigint, file string, n_ids bigint, n_docs bigint"
    made = sorted(ordered.mapInArrow(encode, schema).collect())
    starts = np.cumsum([0] + [r["n_ids"] for r in made])
    listed = [(r["file"], int(s), r["n_ids"], r["n_docs"]) for r, s in zip(made, starts, strict=False)]
    return spark.createDataFrame(listed, "file string, start bigint, n_ids bigint, n_docs bigint")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the files."""
    n_files = files.count()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = filesystem(file)
                with store.open_input_file(path) as source:
                    reader = Reader(source.read())
                begins = np.concatenate(([0], reader.ends[:-1]))
                sums: list[int] = []
                counts = (reader.ends - begins).tolist()
                for a, b in slices(counts, SLICE_CHARS):
                    first = int(begins[a])
                    raw = memoryview(reader.ids(first, int(reader.ends[b - 1])).astype("<u4").tobytes())
                    for s, e in zip(begins[a:b].tolist(), reader.ends[a:b].tolist(), strict=True):
                        sums.append(zlib.crc32(raw[4 * (s - first) : 4 * (e - first)]))
                ids = pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(begins + start, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    dealt = files.select("file", "start").repartition(max(1, n_files))
    return dealt.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer, end_id))
