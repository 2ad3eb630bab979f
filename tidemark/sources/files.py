"""Parquet tables as batch and stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(
    spark: SparkSession,
    folder: str,
    name: str,
    schema: StructType | None = None,
    bytes_per_trigger: int | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The same table as a stream. Files are taken by age, oldest first.

    By default one micro-batch takes all that is there. The bounds cut it into several;
    rows are then judged in the order of delivery: results stay the same if the files
    are in arrival order (rows within a file need not be).

    The path is given as a pattern: the table may be a folder or, as a stream path
    otherwise may not, a single file.
    """
    known = schema or read_table(spark, folder, name).schema
    reader = _bounded(spark.readStream.schema(known), bytes_per_trigger, files_per_trigger)
    return reader.parquet(f"{folder}/{name}[.]parquet")


def _bounded(reader, bytes_per_trigger: int | None, files_per_trigger: int | None):
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader


def stream_folder(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
) -> DataFrame:
    """A folder of parquet files as a stream, oldest file first; bounds as above."""
    return _bounded(spark.readStream.schema(schema), bytes_per_trigger, files_per_trigger).parquet(folder)
