"""Language of a text by interpolated Kneser-Ney character models, one for each language.

*Symbols.* A text is its letters (and their marks) in lower case, with one blank for
whatever stands between words. Each symbol, the blank after the last word included, is
predicted from the ``ORDER - 1`` before it; before a text stand blanks.

*Counts.* Spark counts the windows of ``ORDER`` symbols of all documents that may be learned
from, by language, summed within each buffer before the shuffle. Shorter n-grams count their
distinct left neighbours. With discount D, count c and context h of an n-gram h w:
``p(w|h) = (c(hw) - D) / c(h) + D types(h) / c(h) p(w|h')``, down to equal shares of all
symbols and one more. ``D = (n1 + 1/2) / (n1 + 2 n2 + 1)`` for n1 n-grams seen once, n2 twice.

*Models.* Log probabilities of n-grams and log weights of contexts, each language's in one
array sorted by 64-bit hash. Their size is measured. Up to ``BROADCAST_BYTES`` they are one
broadcast; beyond, n-grams are dealt to shards by the last two symbols of their context, which
all lookups of one window share, and each shard scores its own windows in a pass of its own.

*Decision.* The language with the lowest cross-entropy per symbol (ties: the first in order).
An eighth of the documents to learn from are not counted but calibrate: the ``score`` is the
share of right answers among those with a like lead over the second language (monotone);
a prediction is ``accepted`` if the score is at least ``LEAST_SCORE`` and the cross-entropy
is no higher than all but ``ALPHA`` of that language's documents of like length have it (of
like length or shorter, of any length, of any language where those are fewer than ``LEAST_ROWS``).

Defined cases: ``und`` with score 0 for null texts, texts without a letter, and all texts if
nothing can be learned; rows with a null ``doc_id`` or null ``lang`` teach nothing; rows that
repeat count as often; texts of more than ``PIECE`` code points are read whole, in pieces of
that length that each start anew; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, mixed, slices
from tidemark.session import materialise

ORDER = 5
UNKNOWN = "und"
ALPHA = 0.001
LEAST_SCORE = 0.5

# Documents that no model learns from: remainder of crc32 of the id by four; and the share that calibrates.
HELD_OUT_OF, HELD_OUT = 4, 2
CALIBRATE_OF = 8

PIECE = 1 << 20
BUFFER = 1 << 21
BLANK = 32
LETTER, MARK = 1, 2

# Languages are a label set; more values than this are a mistake in the column.
MOST_LANGUAGES = 1000

# Bytes of a hash and a value.
ENTRY = 12

# Calibration: bins of a lead's logarithm, of a length's logarithm, and of bits a symbol.
LEAD_BINS, LENGTH_BINS, BITS_BINS, BITS_STEP = 96, 24, 512, 1 / 16
LEAST_ROWS = 20

GRAM_SEED, CONTEXT_SEED = 0x51ED270B7D2F1A3C, 0x2545F4914F6CDD1D


@cache
def classes() -> np.ndarray:
    """Of each code point whether it is a letter or a mark."""
    found = np.zeros(0x110000, np.uint8)
    for i in range(len(found)):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LM":
            found[i] = LETTER if kind == "L" else MARK
    return found


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts after each other, each with ``order - 1`` blanks before; and their numbers.

    A text without letters has none and no blanks either.
    """
    lowered = [t.lower() + " " for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")
    if not len(points):
        return points, lengths
    kind = classes()[points]
    starts = np.cumsum(lengths) - lengths
    has_letter = np.add.reduceat((kind == LETTER).astype(np.int64), starts) > 0
    word = kind > 0
    keep = word.copy()
    keep[1:] |= word[:-1]  # of what stands between words, the first; a text ends with a blank, so none reaches the next
    keep &= np.repeat(has_letter, lengths)
    counts = np.add.reduceat(keep.astype(np.int64), starts)
    pad = np.where(has_letter, order - 1, 0)
    out = np.full(int((counts + pad).sum()), BLANK, np.uint32)
    at = np.arange(int(counts.sum())) + np.repeat(np.cumsum(pad), counts)
    out[at] = np.where(word, points, BLANK)[keep]
    return out, counts + pad


def windows(sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``order`` symbols, and the number of the text of each."""
    n = np.maximum(sizes - order + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n)
    return np.arange(len(text)) + np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(n) - n), n), text


def distinct(points: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the number of its content, and the content by number (a row each)."""
    present = np.zeros(0x110000, bool)
    present[points] = True
    n = int(np.count_nonzero(present))
    dense = (np.cumsum(present) - 1)[points]
    key, most = dense[starts], n
    for j in range(1, order):
        if most * n >= 1 << 62:
            key = pd.factorize(key)[0]
            most = int(key.max()) + 1
        key, most = key * n + dense[starts + j], most * n
    number = pd.factorize(key)[0]
    first = np.empty(int(number.max(initial=-1)) + 1, np.int64)
    first[number[::-1]] = starts[::-1]
    return number, points[first[:, None] + np.arange(order)]


def pieces(text: str) -> list[str]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [""]


def _crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_crc(doc_id) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def _calibrates(doc_id: Column) -> Column:
    return F.floor(_crc(doc_id) / HELD_OUT_OF) % CALIBRATE_OF == 0


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: windows of ``order`` symbols by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).extend(pieces(text))
            for lang, texts in by_lang.items():
                for a, b in slices(list(map(len, texts)), BUFFER):
                    points, sizes = symbols(texts[a:b], order)
                    number, rows = distinct(points, windows(sizes, order)[0], order)
                    joined = rows.astype("<u4").tobytes().decode("utf-32-le")
                    grams = [joined[i : i + order] for i in range(0, len(joined), order)]
                    n = np.bincount(number, minlength=len(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(rows), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())],
                        names=["lang", "gram", "n"],
                    )

    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return known.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def levels(top: DataFrame, order: int) -> list[DataFrame]:
    """Counts of n-grams of 1, 2, ... symbols: below ``top``, of distinct left neighbours."""
    found = [top]
    for _ in range(order - 1):
        shorter = found[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        found.insert(0, materialise(shorter, "grams"))
    return found


def probabilities(top: DataFrame, order: int) -> DataFrame:
    """lang, kind (0 n-gram, 1 context), gram, value: natural logarithms of all languages' models."""
    tables = levels(top, order)
    n_symbols = tables[0].select("gram").distinct().count() + 1
    below: DataFrame | None = None
    out: DataFrame | None = None
    once = [F.count_if(F.col("n") == k) for k in (1, 2)]
    for table in tables:
        # One row for each language.
        discount = table.groupBy("lang").agg(((once[0] + 0.5) / (once[0] + 2 * once[1] + 1)).alias("d"))
        rows = table.join(F.broadcast(discount), "lang")
        rows = rows.select("lang", "gram", "n", "d", F.expr("substring(gram, 1, length(gram) - 1)").alias("context"))
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"), F.first("d").alias("d"))
        totals = totals.select("lang", "context", "total", (F.col("d") * F.col("types") / F.col("total")).alias("rest"))
        totals = materialise(totals, "contexts")
        rows = rows.join(totals, ["lang", "context"])
        if below is None:
            rows = rows.withColumn("p", F.lit(1.0 / n_symbols))
            totals = totals.withColumn("rest", F.col("rest") / n_symbols)  # what a symbol never seen gets
        else:
            shorter = below.select("lang", F.col("gram").alias("suffix"), "p")
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, ["lang", "suffix"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("rest") * F.col("p")
        below = materialise(rows.select("lang", "gram", p.alias("p")), "probabilities")
        both = below.select("lang", F.lit(0).alias("kind"), "gram", F.log("p").alias("value")).unionByName(
            totals.select("lang", F.lit(1).alias("kind"), F.col("context").alias("gram"), F.log("rest").alias("value"))
        )
        out = both if out is None else out.unionByName(both)
    return out


def folded(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hash of a string one symbol longer to the left."""
    return mixed((h ^ points.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _seeds(seed: int, n: int) -> np.ndarray:
    return np.full(n, seed, np.uint64)


def shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the last two symbols of a context, one context a row."""
    h = folded(folded(_seeds(CONTEXT_SEED, len(context)), context[:, -1]), context[:, -2])
    return (h >> np.uint64(7)).astype(np.int64) % shards


def hashed(values: DataFrame, shards: int) -> DataFrame:
    """lang, shard (null: in all of them), hash, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, grams = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            lengths = np.fromiter(map(len, grams), np.int64, len(grams))
            hashes = np.where(kinds == 0, np.uint64(GRAM_SEED), np.uint64(CONTEXT_SEED))
            shard = np.full(len(grams), -1, np.int64)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                raw = "".join(grams[i] for i in at.tolist()).encode("utf-32-le")
                points = np.frombuffer(raw, "<u4").reshape(len(at), n)
                for j in range(n - 1, -1, -1):
                    hashes[at] = folded(hashes[at], points[:, j])
                for kind, m in ((0, n - 1), (1, n)):
                    if m >= 2:
                        own = kinds[at] == kind
                        shard[at[own]] = shard_of(points[own, :m], shards)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shard, mask=shard < 0), pa.array(hashes.view(np.int64)), batch.column(3)],
                names=["lang", "shard", "hash", "value"],
            )

    rows = values.select("lang", "kind", "gram", "value")
    return rows.mapInArrow(run, "lang string, shard bigint, hash bigint, value double")


@dataclass
class Models:
    """Of each language the sorted hashes with their values, and what a symbol never seen gets."""

    order: int
    hashes: list[np.ndarray]
    values: list[np.ndarray]

    def _look_up(self, lang: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.hashes[lang]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return known[at] == hashes, self.values[lang][at]

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of the last symbol of each row given the others, by language."""
        n, order = len(rows), self.order
        grams, contexts = [_seeds(GRAM_SEED, n)], [_seeds(CONTEXT_SEED, n)]
        for j in range(order - 1, -1, -1):
            grams.append(folded(grams[-1], rows[:, j]))
            if j:
                contexts.append(folded(contexts[-1], rows[:, j - 1]))
        out = np.zeros((n, len(self.hashes)))
        for lang in range(len(self.hashes)):
            todo = np.arange(n)
            for k in range(order, 0, -1):
                found, value = self._look_up(lang, grams[k][todo])
                out[todo[found], lang] += value[found]
                todo = todo[~found]
                found, value = self._look_up(lang, contexts[k - 1][todo])
                out[todo[found], lang] += value[found]
        return out

    def sums(self, texts: list[str], shard: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and their log probabilities by language (of the shard's windows)."""
        parts = [pieces(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), list(map(len, parts)))
        points, sizes = symbols([p for ps in parts for p in ps], self.order)
        starts, piece = windows(sizes, self.order)
        owners = owner[piece]
        total = np.zeros((len(texts), len(self.hashes)))
        if len(starts):
            number, rows = distinct(points, starts, self.order)
            logs = np.zeros((len(rows), len(self.hashes)))
            own = shard_of(rows[:, :-1], shards) == shard if shards > 1 else np.ones(len(rows), bool)
            logs[own] = self.log_probabilities(rows[own])
            for lang in range(len(self.hashes)):
                total[:, lang] = np.bincount(owners, logs[:, lang][number], len(texts))
        return np.bincount(owners, minlength=len(texts)), total


@dataclass
class Trained:
    """Languages, and the table of their models: lang, shard, hash, value."""

    languages: list[str]
    table: DataFrame
    shards: int
    order: int

    def models(self, shard: int) -> Models:
        """One shard, of at most ``BROADCAST_BYTES`` or so by its measured size."""
        rows = self.table.where(F.col("shard").isNull() | (F.col("shard") == shard)).select("lang", "hash", "value").toArrow()
        hashes, values = [], []
        lang = rows.column("lang").to_pandas()
        for name in self.languages:
            own = rows.filter(pa.array(lang == name))
            h, v = own.column("hash").to_numpy().view(np.uint64), own.column("value").to_numpy().astype(np.float32)
            order = np.argsort(h)
            hashes.append(h[order])
            values.append(v[order])
        return Models(self.order, hashes, values)


def train(docs: DataFrame, order: int = ORDER, most_bytes: int = BROADCAST_BYTES) -> Trained:
    """Models of the non-null values of ``lang`` of all rows of ``docs``."""
    if order < 3:
        raise ValueError("order: 3 or more")
    top = materialise(counted(docs, order), "grams")
    languages = sorted(r.lang for r in top.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    values = materialise(probabilities(top, order), "model")
    shards = max(1, math.ceil(values.count() * ENTRY / most_bytes))
    return Trained(languages, materialise(hashed(values, shards), "model-hashes"), shards, order)


SUMS = "size bigint, logs array<double>"


def _pass(rows: DataFrame, trained: Trained, shard: int, key: str, kinds: str) -> DataFrame:
    """``key`` columns, size and logs of rows that also have text, by one shard of the models."""
    shared = rows.sparkSession.sparkContext.broadcast(trained.models(shard))
    shards, names = trained.shards, [c.strip() for c in key.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for a, b in slices(list(map(len, texts)), BUFFER):
                size, logs = shared.value.sums(texts[a:b], shard, shards)
                flat = pa.ListArray.from_arrays(np.arange(len(logs) + 1, dtype=np.int32) * logs.shape[1], pa.array(logs.ravel()))
                keys = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(size.astype(np.int64)), flat], names=[*names, "size", "logs"])

    return rows.select(*names, "text").mapInArrow(run, f"{kinds}, {SUMS}")


def measured(docs: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, lang, size (symbols), logs (sum of log probabilities by language) of every row."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    if trained.shards == 1:
        return _pass(rows, trained, 0, "doc_id, lang", "doc_id bigint, lang string")
    # Sums of shards meet by text; equal texts have equal sums.
    named = rows.withColumn("body", F.sha2("text", 256))
    parts: DataFrame | None = None
    for shard in range(trained.shards):
        own = _pass(named, trained, shard, "body", "body string").withColumn("shard", F.lit(shard))
        own = materialise(own.dropDuplicates(["body"]), "shard-sums")
        parts = own if parts is None else parts.unionByName(own)
    each = [F.sum(F.col("logs")[i]) for i in range(len(trained.languages))]
    sums = parts.groupBy("body").agg(F.first("size").alias("size"), F.array(*each).alias("logs"))
    return named.drop("text").join(sums, "body").drop("body")


def decided(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds best (place of the language), bits (a symbol) and lead (bits over the second) to ``measured`` rows."""
    best = F.array_max("logs")
    second = F.coalesce(F.get(F.sort_array("logs", asc=False), F.lit(1)), F.lit(-1e9))
    return rows.select(
        "*", (F.array_position("logs", best) - 1).cast("int").alias("best"),
        (-best / F.greatest("size", F.lit(1)) / math.log(2)).alias("bits"), ((best - second) / math.log(2)).alias("lead"),
    )


def _lead_bin(lead: Column) -> Column:
    return F.least(F.floor(F.log2(1 + lead) * 4), F.lit(LEAD_BINS - 1)).cast("int")


def _length_bin(size: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)))), F.lit(LENGTH_BINS - 1)).cast("int")


def _bits_bin(bits: Column) -> Column:
    return F.least(F.floor(bits / BITS_STEP), F.lit(BITS_BINS - 1)).cast("int")


def rising(right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shares that never fall, nearest to those of the bins: bins that do are pooled with the one before."""
    pools: list[list[float]] = []
    for r, t in zip(right, total, strict=True):
        pools.append([r, t, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            r2, t2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + r2, pools[-1][1] + t2, pools[-1][2] + n2]
    return np.concatenate([np.full(int(n), r / t) for r, t, n in pools])


def first_with_enough(*counts: np.ndarray) -> np.ndarray:
    """The first that counts ``LEAST_ROWS`` rows, or the last."""
    return next((c for c in counts if c.sum() >= LEAST_ROWS), counts[-1])


def highest_bin(counts: np.ndarray, alpha: float) -> int:
    """The lowest bin with at most a share ``alpha`` of the rows above it; without rows, the highest there is."""
    above = counts.sum() - np.cumsum(counts)
    return int(np.argmax(above <= alpha * counts.sum())) if counts.any() else BITS_BINS


@dataclass
class Calibration:
    """Score by bin of the lead; highest accepted bin of bits by language and bin of length."""

    scores: list[float]
    highest: list[int]


def calibrate(docs: DataFrame, trained: Trained, alpha: float = ALPHA) -> Calibration:
    """From all labelled rows of ``docs``, which the models have not seen. Bins come to the driver."""
    languages = trained.languages
    rows = decided(measured(docs.where("lang IS NOT NULL"), trained).where("size > 0"), languages)
    right = F.get(F.lit(languages), F.col("best")) == F.col("lang")
    rows = rows.select("best", right.alias("right"), _lead_bin(F.col("lead")).alias("lead"), _length_bin(F.col("size")).alias("length"), _bits_bin(F.col("bits")).alias("bits"))
    bins = materialise(rows.groupBy("best", "right", "lead", "length", "bits").count(), "calibration")
    by_lead = bins.groupBy("lead").agg(F.sum("count"), F.sum(F.when(F.col("right"), F.col("count")).otherwise(0))).collect()
    # Before any row: as one guess among the languages; a bin without rows goes with its neighbours.
    total, hits = np.full(LEAD_BINS, 1e-6), np.full(LEAD_BINS, 1e-6 / len(languages))
    total[0], hits[0] = 1.0, 1.0 / len(languages)
    for r in by_lead:
        total[r[0]] += r[1]
        hits[r[0]] += r[2]
    seen = np.flatnonzero(total >= 0.5)
    shares = np.interp(np.arange(LEAD_BINS), seen, rising(hits[seen], total[seen]))
    counts = np.zeros((len(languages), LENGTH_BINS, BITS_BINS), np.int64)
    own = bins.where("right").groupBy("best", "length", "bits").agg(F.sum("count").alias("n")).toPandas()
    np.add.at(counts, (own.best, own.length, own.bits), own.n)
    highest = [
        highest_bin(first_with_enough(lang[b], lang[: b + 1].sum(0), lang.sum(0), counts.sum((0, 1))), alpha)
        for lang in counts
        for b in range(LENGTH_BINS)
    ]
    return Calibration([float(x) for x in shares], highest)


def fit(docs: DataFrame, order: int = ORDER, most_bytes: int = BROADCAST_BYTES) -> tuple[Trained, Calibration | None]:
    """Models and their calibration from the rows that may be learned from; None without rows to calibrate on."""
    may = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    trained = train(may.where(~_calibrates(F.col("doc_id"))), order, most_bytes)
    if not trained.languages:
        return trained, None
    return trained, calibrate(may.where(_calibrates(F.col("doc_id"))), trained)


def identified(docs: DataFrame, trained: Trained, calibration: Calibration | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, bits, size of every document."""
    aside = held_out(F.col("doc_id")).alias("held_out")
    if not trained.languages:
        nothing = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")]
        return docs.select("doc_id", aside, *nothing, F.lit(None).cast("double").alias("bits"), F.lit(0).cast("long").alias("size"))
    rows = decided(measured(docs, trained), trained.languages)
    known = F.col("size") > 0
    score = F.get(F.lit(calibration.scores), _lead_bin(F.col("lead")))
    place = F.col("best") * LENGTH_BINS + _length_bin(F.col("size"))
    usual = _bits_bin(F.col("bits")) <= F.get(F.lit(calibration.highest), place)
    return rows.select(
        "doc_id", aside,
        F.when(known, F.get(F.lit(trained.languages), F.col("best"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, score).otherwise(0.0).alias("score"),
        (known & (score >= LEAST_SCORE) & usual).alias("accepted"),
        F.when(known, F.col("bits")).alias("bits"), "size",
    )
