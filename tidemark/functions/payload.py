"""Text form of feature vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_map(entries: Column) -> Column:
    """Map from an array of (name, value) structs, entries in name order."""
    return F.map_from_entries(F.array_sort(entries))


def vector_json(bucket: Column, values: Column) -> Column:
    """JSON text of one vector, its time in UTC; features without a value appear as null."""
    return F.to_json(
        F.struct(bucket.alias("bucket"), values.alias("values")),
        {"ignoreNullFields": "false", "timeZone": "UTC"},
    )
