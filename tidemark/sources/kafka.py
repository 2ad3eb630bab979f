"""Kafka adapters; they need Spark's own Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

# Addresses and topics of the jobs.
SERVERS = "localhost:9092"
TOPIC = "test"
TOPIC_OUT = "test-out"


def source_options(
    servers: str = SERVERS, topic: str = TOPIC, max_offsets: int | None = None
) -> dict[str, str]:
    """Offsets default to latest.

    ``max_offsets`` bounds what one micro-batch takes, and with it what a busy key can
    hold at once; by default nothing does.
    """
    bound = {"maxOffsetsPerTrigger": str(max_offsets)} if max_offsets else {}
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, **bound}


def sink_options(servers: str = SERVERS, topic: str = TOPIC_OUT) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def read_stream(spark: SparkSession, **options) -> DataFrame:
    """Records with key, value, timestamp, partition and offset."""
    reader = spark.readStream.format("kafka").options(**source_options(**options))
    return reader.load().select("key", "value", "timestamp", "partition", "offset")


def write_stream(messages: DataFrame, **options) -> DataStreamWriter:
    """Writer for ``(key, value)`` text messages."""
    return messages.writeStream.format("kafka").options(**sink_options(**options))
