"""Hierarchical packing of documents into training sequences of several lengths.

1. *Route.* Full windows of a document become sequences of the longest tier; what is left
   over goes to the shortest tier that holds it.
2. *Pack* each tier, longest first: one routed piece opens a sequence, and its gap is
   filled from the shorter tiers, the largest fitting piece first. A last gap that no
   piece fits takes the head of one; the rest of that piece is routed again. So every
   sequence is exactly as long as its tier, which is a power of two, and none is padded.
3. What the shortest tier leaves at the end (less than one sequence) is cut into sequences
   of smaller powers of two.
4. *Balance.* Sequences of a tier are dealt to steps of equally many tokens, the costliest
   first, back and forth over the steps; the cost is the attention within its pieces.

Packing is local: a task packs chunks of some thousand documents of its input as they
come, without a shuffle, and no chunk knows of another. Sequence and step numbers are made
of the partition and a count, so they are unique.

Defined cases: a null text is empty (its end id is still packed); a null ``doc_id`` stays
null; rows that repeat are packed each; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import slices, text_or_empty
from tidemark.llm.word_ids import MOST_PIECES, word_ids

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16_384
CHUNK_CHARS = 4_000_000
# Characters encoded at once: what that takes beside the ids is many times as large as they are.
ENCODE_CHARS = 500_000
END_ID = 1

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier bigint, step_id bigint"
)


class _Tier:
    """Pieces (length, document, start), ordered by length."""

    def __init__(self):
        self.pieces: list[tuple[int, int, int]] = []

    def largest_upto(self, room: int) -> tuple[int, int, int] | None:
        at = bisect_right(self.pieces, (room, 1 << 62, 0))
        return self.pieces.pop(at - 1) if at else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, pieces) of documents with these lengths; a piece is (document, start, length)."""
    longest, shortest = tiers[-1], tiers[0]
    store = {tier: _Tier() for tier in tiers}
    done: list[tuple[int, list[tuple[int, int, int]]]] = []

    def home(n: int) -> _Tier:
        return store[next(t for t in tiers if n <= t)]

    for doc, n in enumerate(lengths):
        full = n // longest * longest
        done.extend((longest, [(doc, at, longest)]) for at in range(0, full, longest))
        if n > full:
            home(n - full).pieces.append((n - full, doc, full))
    for tier in store.values():
        tier.pieces.sort()

    def draw(room: int, below: list[int]) -> tuple[int, int, int] | None:
        """The largest piece of the tiers that fits, or the head of the smallest that doesn't."""
        for t in reversed(below):
            if found := store[t].largest_upto(room):
                return found
        for t in below:
            if store[t].pieces:
                n, doc, start = store[t].pieces.pop(0)
                insort(home(n - room).pieces, (n - room, doc, start + room))
                return room, doc, start
        return None

    tail: list[tuple[int, int, int]] = []  # of the tier at hand, when nothing is left to fill it
    for k in range(len(tiers) - 1, -1, -1):
        size, below = tiers[k], list(tiers[: k + 1] if k == 0 else tiers[:k])
        own = store[size]
        while own.pieces:
            n, doc, start = own.pieces.pop()
            row, room = [(doc, start, n)], size - n
            while room and (piece := draw(room, below)):
                row.append((piece[1], piece[2], piece[0]))
                room -= piece[0]
            if room:
                tail.extend(row)
            else:
                done.append((size, row))
    # Ends that could not be filled: cut into the largest powers of two that they give.
    total = sum(n for _, _, n in tail)
    while total:
        size = min(longest, 1 << (total.bit_length() - 1))
        row, room = [], size
        while room:
            doc, start, n = tail.pop()
            use = min(n, room)
            row.append((doc, start, use))
            if use < n:
                tail.append((doc, start + use, n - use))
            room -= use
        done.append((size, row))
        total -= size
    return done


def steps(sequences: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence: those of a step have one tier and, together, ``step_tokens`` tokens."""
    number = [0] * len(sequences)
    first = 0
    by_tier: dict[int, list[int]] = {}
    for i, (tier, _) in enumerate(sequences):
        by_tier.setdefault(tier, []).append(i)
    for tier in sorted(by_tier):
        members = sorted(by_tier[tier], key=lambda i: (-sum(n * n for _, _, n in sequences[i][1]), i))
        n_steps = -(-len(members) * tier // max(step_tokens, tier))
        for rank, i in enumerate(members):
            lap, at = divmod(rank, n_steps)
            number[i] = first + (at if lap % 2 == 0 else n_steps - 1 - at)
        first += n_steps
    return number


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    most_pieces: int = MOST_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    ``most_pieces`` bounds what a worker remembers of words it has met: less memory, more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer, end_id, False, most_pieces)
        next_sequence = next_step = TaskContext.get().partitionId() << 36
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            lengths = pc.utf8_length(texts).to_pylist()
            for a, b in slices(lengths, CHUNK_CHARS):
                parts = [
                    coder.encode(texts.slice(a + c, d - c).to_pylist()) for c, d in slices(lengths[a:b], ENCODE_CHARS)
                ]
                ids, counts = (np.concatenate(x) for x in zip(*parts))
                del parts
                sequences = pack(counts.tolist(), tiers)
                step_of = steps(sequences, step_tokens)
                raw = memoryview(ids.astype("<u4").tobytes())
                begins = (np.cumsum(counts) - counts).tolist()
                rows = []
                for s, (tier, pieces) in enumerate(sequences):
                    offset = 0
                    for doc, start, n in pieces:
                        at = 4 * (begins[doc] + start)
                        crc = zlib.crc32(raw[at : at + 4 * n])
                        rows.append((doc, start, n, crc, next_sequence + s, offset, tier, next_step + step_of[s]))
                        offset += n
                next_sequence += len(sequences)
                next_step += max(step_of, default=-1) + 1
                doc, start, n, crc, sequence, offset, tier, step = np.array(rows, np.int64).reshape(-1, 8).T
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a).take(pa.array(doc)), *map(pa.array, (start, n, crc, counts[doc], sequence, offset, tier, step))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"],
                )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, SCHEMA)
