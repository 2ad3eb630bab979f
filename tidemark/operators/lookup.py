"""Equi-joins of readings with settings tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Lookup

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def lookup_join(
    rows: DataFrame,
    table: Lookup,
    on: list[str],
    how: str = "inner",
    spread: str | Column = "arrival",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` with a settings table.

    A table of at most ``broadcast_bytes`` (measured, not estimated) is
    broadcast. A larger one is copied ``SALTS`` times and joined by shuffle on
    the key and a salt taken from ``spread``, so that a key holding a large share
    of the rows is spread over many tasks.
    """
    if table.size <= broadcast_bytes:
        return rows.join(F.broadcast(table.frame), on, how)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = table.frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")
