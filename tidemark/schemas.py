"""Message schemas."""

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

PERSON = StructType(
    [
        StructField("name", StringType()),
        StructField("sex", StringType()),
        StructField("age", IntegerType()),
        StructField("timestamp", TimestampType()),
    ]
)

READING = StructType(
    [
        StructField("name", StringType()),
        StructField("device", StringType()),
        StructField("value", DoubleType()),
        StructField("timestamp", TimestampType()),
    ]
)
