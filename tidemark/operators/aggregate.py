"""Bucket aggregates.

Three different rules for equal event times:

* keyed state       first arrival wins   (:func:`latest_first`)
* state per bucket  last arrival wins    (:func:`latest_last`)
* built-in window   larger value wins    (:func:`latest_larger`)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_first(keep: Column | None = None) -> Column:
    order = F.struct(-F.col("ts_us"), F.col("arrival"))
    return F.min_by("value", order if keep is None else F.when(keep, order))


def latest_last(keep: Column | None = None) -> Column:
    order = F.struct(F.col("ts_us"), F.col("arrival"))
    return F.max_by("value", order if keep is None else F.when(keep, order))


def latest_larger(keep: Column | None = None) -> Column:
    pair = F.struct(F.col("ts_us").alias("ts"), F.col("value").alias("value"))
    return F.max(pair if keep is None else F.when(keep, pair)).getField("value")


def mean(keep: Column | None = None) -> Column:
    return F.avg("value" if keep is None else F.when(keep, F.col("value")))


def by_setting(rows: DataFrame, by: list[str], latest=latest_first) -> DataFrame:
    """``value`` per group: the latest value or the mean, as the settings say.

    ``latest`` is constant within a group, so each row feeds one of the two. Groups
    are formed bucket first: input mostly in time order is then nearly sorted for
    the sort that aggregates ordered by structs need.
    """
    wanted = F.col("latest")
    return rows.groupBy("bucket_ms", *[name for name in by if name != "bucket_ms"]).agg(
        F.coalesce(latest(wanted), mean(~wanted)).alias("value"), F.count("*").alias("n_rows")
    )
