"""Bounded samples of labelled documents for training, and scoring jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, slices, text_or_empty

# Bounds of a training sample: rows of either label, and bytes of a text in it.
ROWS_PER_LABEL = 2500
MOST_BYTES = 16_384

SCORE_CHARS = 2_000_000


def sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_LABEL, most_bytes: int = MOST_BYTES
) -> pd.DataFrame:
    """doc_id, y (label), lang, text of at most ``rows`` documents of each label.

    Rows whose crc32 of the id is divisible by five are never taken, and neither are texts of
    more than ``most_bytes`` (whole texts only). Of what is left those with the smallest hash
    of the id are, so that reruns agree and a label that has ``rows`` such documents fills its
    part. Labels other than 0 and 1 don't count; a document with labels of both kinds doesn't
    either, nor do null ids. Of rows that share an id one is taken, the same in every run.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most"))
    known = known.where("y = most").select("doc_id", "y", F.xxhash64("doc_id").alias("order"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select("doc_id", lang.alias("lang"), text_or_empty().alias("text"))
    short = found.where(F.octet_length("text") <= most_bytes)
    there = known.join(short.select("doc_id").distinct(), "doc_id")
    chosen = None
    for y in (0, 1):
        few = there.where(F.col("y") == y).orderBy("order", "doc_id").limit(rows)
        chosen = few if chosen is None else chosen.unionByName(few)
    # At most 2 * rows ids: small enough to broadcast whatever the size of the tables.
    taken = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "order")
    one = taken.agg(F.min(F.struct(F.xxhash64("text", "lang").alias("h"), "lang", "text")).alias("one"))
    return one.select("doc_id", "y", "one.lang", "one.text").orderBy("y", "order", "doc_id").toPandas()


def batches(y: np.ndarray, size: int, n: int, seed: int) -> Iterator[np.ndarray]:
    """``n`` batches of row numbers, half of each label; a label's rows come round in shuffled laps."""
    rng = np.random.default_rng(seed)
    half = size // 2
    laps = []
    for label in (0, 1):
        rows = np.nonzero(y == label)[0]
        n_laps = -(-n * half // len(rows))
        laps.append(np.concatenate([rng.permutation(rows) for _ in range(n_laps)]))
    for i in range(n):
        yield np.concatenate([rows[i * half : (i + 1) * half] for rows in laps])


def scored(
    docs: DataFrame, score: Callable[[object, list[bytes]], object], model: object, threshold: float, lang: bool = False
) -> DataFrame:
    """doc_id, held_out, score, predicted (and lang) of every document.

    ``score(model, texts)`` gives the scores of whole texts as UTF-8 bytes; the model, of
    fixed size, goes to the executors as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = ["lang"] if lang else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            for a, b in slices(list(map(len, texts)), SCORE_CHARS):
                scores = pa.array(score(shared.value, texts[a:b]), pa.float64())
                rest = [batch.column(2 + i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), scores, *rest], names=["doc_id", "score", *keep]
                )

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"), *keep)
    out = rows.mapInArrow(run, "doc_id bigint, score double" + ", lang string" * lang)
    aside = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return out.select(
        "doc_id", aside.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keep
    )
