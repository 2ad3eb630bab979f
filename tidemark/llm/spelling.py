"""Spelling variants: words one edit apart, found in a reduced alphabet.

*Words.* Maximal runs of Latin letters, lower-cased (A-Z), with a character left out at
places that the contract draws; the distinct ones of ``LEAST_CHARS`` code points and
``LEAST_TIMES`` occurrences over all documents are the vocabulary.

*Reduced words.* A hash maps each letter to one of ``SYMBOLS`` symbols. Words one edit apart
are at most one edit apart in reduced form. For every word all reduced strings within one edit
of its own (deletions, replacements, insertions, and itself) are generated as 64-bit keys
and joined with the keys of the reduced vocabulary; pairs that meet are verified on the
original words, so clashes of symbols or keys cost time and change no result.

*Few rows.* A key is a polynomial, so each edit's key comes from running sums without making
the string: long words cost their length, not its square. A bit set of all keys of the
vocabulary (``bits`` at most ``MOST_BITS``, one of a fixed number of words a row) drops most
generated keys before the shuffle; a full one drops fewer and changes nothing.

*Forms.* A word's form is its near word with the most occurrences (ties: the smallest word),
if these are ``TIMES`` times its own; its root is what following forms ends at. A hop
multiplies occurrences by ``TIMES``, so roots are found in five doublings at most.

Defined cases: a null text has no words; a null ``doc_id`` is drawn for as an empty one
(``:run``); rows that repeat count as often as they occur; a table without such words gives
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mixed
from tidemark.session import materialise

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_CHARS = 7
LEAST_TIMES = 2
TIMES = 10
SYMBOLS = 8
DROP_ONE_OF = 31

# The bit set: bits for each word, least and most bits (32 MB).
BITS_A_WORD = 64
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28

# Keys generated at once.
KEYS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def occurrences(docs: DataFrame) -> DataFrame:
    """word: each run of letters of each document, as the vocabulary counts it."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    tagged = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.withColumn("h", F.crc32(tagged.cast("binary")))
    shorter = F.expr("concat(substring(run, 1, CAST(h % length(run) AS INT)), substring(run, CAST(h % length(run) AS INT) + 2))")
    return runs.select(F.when(F.col("h") % DROP_ONE_OF == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """word, n: the words that are compared, with their occurrences."""
    long = occurrences(docs).where(F.char_length("word") >= least_chars)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def reduced(words: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols of code points."""
    spread = (words.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return ((spread * np.uint64(symbols)) >> np.uint64(32)).astype(np.int64)


def _values(symbols: int) -> np.ndarray:
    return mixed(np.arange(1, symbols + 1, dtype=np.uint64) * BASE)


def _powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))))


def _key(total: np.ndarray, length: int) -> np.ndarray:
    return mixed(total + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def own_keys(code: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of reduced words of one length, one a row of ``code``."""
    n = code.shape[1]
    return _key((_values(symbols)[code] * _powers(n)[:n]).sum(axis=1, dtype=np.uint64), n)


def edit_keys(code: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of all reduced strings within one edit of each row of ``code``; some more than once."""
    rows, n = code.shape
    values, power = _values(symbols), _powers(n + 1)
    terms = values[code] * power[:n]
    before = np.concatenate((np.zeros((rows, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    total = before[:, -1:]
    after = total - before
    deleted = before[:, :-1] + after[:, 1:] * INVERSE
    each = values[None, None, :]
    replaced = (total - terms)[:, :, None] + each * power[None, :n, None]
    inserted = (before + after * BASE)[:, :, None] + each * power[None, : n + 1, None]
    return np.concatenate(
        (_key(deleted, n - 1), _key(replaced.reshape(rows, -1), n), _key(inserted.reshape(rows, -1), n + 1)), axis=1
    )


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and reduced forms of words of one length, as many as ``KEYS`` allows."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, KEYS // ((n + 1) * (2 * symbols + 1)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            points = np.frombuffer("".join(words[k] for k in part.tolist()).encode("utf-32-le"), "<u4")
            yield part, reduced(points.reshape(len(part), n), symbols)


def with_keys(vocab: DataFrame, symbols: int) -> DataFrame:
    """word, n and key (of its reduced form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(len(batch), np.uint64)
            for at, code in _by_length(batch.column(0).to_pylist(), symbols):
                keys[at] = own_keys(code, symbols)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys.view(np.int64))], names=["word", "n", "key"]
            )

    return vocab.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint")


def key_bits(keyed: DataFrame, n_words: int) -> np.ndarray:
    """Bit set of all keys: bit ``key % bits``. At most ``MOST_BITS`` / 64 rows come to the driver."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n_words * BITS_A_WORD):
        bits *= 2
    at = F.col("key").bitwiseAND(F.lit(bits - 1).cast("long"))
    place = F.shiftright(at, 6)
    one = F.expr("shiftleft(1L, CAST(key & 63L AS INT))")
    rows = keyed.groupBy(place.alias("place")).agg(F.bit_or(one).alias("bits")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[rows.column("place").to_numpy()] = rows.column("bits").to_numpy()
    return found.view(np.uint8)


def edits(keyed: DataFrame, bits: np.ndarray, symbols: int) -> DataFrame:
    """id, key: for each word the keys within one edit of its reduced form that the bit set may hold."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        mask = np.uint64(len(known) * 8 - 1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, code in _by_length(batch.column(1).to_pylist(), symbols):
                keys = edit_keys(code, symbols)
                bit = keys & mask
                hit = (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                row, column = np.nonzero(hit)
                key = keys[row, column].view(np.int64)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.ones(len(row), bool)
                new[1:] = (np.diff(row) != 0) | (np.diff(key) != 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[row[new]]]), pa.array(key[new])], names=["id", "key"])

    return keyed.select("id", "word").mapInArrow(run, "id bigint, key bigint")


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, other, m: words of the vocabulary one edit apart, each pair both ways."""
    keyed = with_keys(vocab, symbols).withColumn("id", F.xxhash64("word"))
    keyed = materialise(keyed, "reduced-words")
    bits = key_bits(keyed, keyed.count())
    made = edits(keyed, bits, symbols).join(keyed.select("key", F.col("id").alias("other_id")), "key")
    left = keyed.select("id", "word", "n")
    right = keyed.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("m"))
    # Every pair is made from both its words; one is enough to verify (equal ids: a word itself, or a clash).
    once = made.where("id <= other_id").select("id", "other_id").join(left, "id").join(right, "other_id")
    found = once.where((F.levenshtein("word", "other", 1) == 1) & F.expr("id < other_id OR word < other"))
    ways = [F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))]
    return found.select(F.explode(F.array(*ways)).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow each word. ``forms`` has word and form (not null)."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(now.join(on, "root", "left").select("word", "root", "next"), "roots")
        if moved.where("next IS NOT NULL").isEmpty():
            return now
        now = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, times: int = TIMES, symbols: int = SYMBOLS
) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word of the vocabulary."""
    vocab = materialise(vocabulary(docs, least_chars, least_times), "words")
    best = F.min(F.struct((-F.col("m")).alias("less"), "other"))
    near = near_pairs(vocab, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = vocab.join(near, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    rows = rows.select(
        "word", "n", F.when(enough, F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    rows = materialise(rows, "forms")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"
    )
