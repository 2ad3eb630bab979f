"""From Kafka-shaped records to parsed readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.timegrain import arrival, event_us

_CORRUPT = "_corrupt"
_OFFSET_BITS = 46
_PARTITION_BITS = 17


def decode(records: DataFrame) -> DataFrame:
    """Key and value bytes as text; the other record columns stay."""
    return records.withColumn("key", F.col("key").cast("string")).withColumn(
        "json_value", F.col("value").cast("string")
    ).drop("value")


def with_arrival(decoded: DataFrame) -> DataFrame:
    """Arrival order from the record's time, partition and offset.

    The time keeps its full precision; partition and offset make the order total. Where
    these are out of range there is no arrival, and the record is rejected as such.
    """
    tie = _record_tie()
    return decoded.withColumn(
        "arrival", F.when(tie.isNotNull(), arrival(event_us(F.col("timestamp")), tie))
    )


def _record_tie() -> Column:
    """Partition and offset in one number; null for a record that does not fit."""
    partition, offset = F.col("partition").cast("bigint"), F.col("offset")
    fits = offset.between(0, 2**_OFFSET_BITS - 1) & partition.between(0, 2**_PARTITION_BITS - 1)
    return F.when(fits, F.shiftleft(partition, _OFFSET_BITS) + offset)


def parse(decoded: DataFrame, schema: StructType, *kept: str) -> DataFrame:
    """Message fields as columns, with ``bad_json`` set where the text is no such message."""
    marked = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    parsed = F.from_json("json_value", marked, {"columnNameOfCorruptRecord": _CORRUPT, "timeZone": "UTC"})
    names = [f"r.{field.name}" for field in schema.fields]
    bad = F.col("json_value").isNull() | F.col(f"r.{_CORRUPT}").isNotNull()
    return decoded.select(parsed.alias("r"), "json_value", *kept).select(
        *names, bad.alias("bad_json"), *kept
    )


def person_readings(people: DataFrame) -> DataFrame:
    """Person messages in the general shape: the key is ``sex``, the value is ``age``."""
    rest = [c for c in people.columns if c not in ("name", "sex", "age", "timestamp")]
    return people.select(
        F.col("sex").alias("key"), F.col("age").cast("double").alias("value"), "timestamp", *rest
    )
