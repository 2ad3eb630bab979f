"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

# A side of a join is broadcast only below this measured or proven size.
BROADCAST_BYTES = 64 * 1024**2


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, which every worker has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_row(frame: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, with the whole row kept aside in ``_row``.

    Whatever else the input has, its names cannot clash with those an operator makes.
    """
    return frame.select(F.struct("*").alias("_row"), *needed)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_bytes(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array with ``gap`` zero bytes after each; starts and lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1])) if len(texts) else lengths
    pad = b"\0" * gap
    return np.frombuffer(pad.join(texts) + pad, np.uint8), starts, lengths


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose lengths add up to about ``most``."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
