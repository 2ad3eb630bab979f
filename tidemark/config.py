"""Per-key settings as small tables.

Settings come as plain maps (the usual case) or as DataFrames of any size. Each
table carries its measured size, which decides between a broadcast and a
shuffled lookup (see :mod:`tidemark.operators.lookup`).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

LATEST = "latest"
AVERAGE = "average"

# Settings of the people jobs, key -> value.
PEOPLE_STEPS_MS = {"m": 5000, "f": 10000}
PEOPLE_AGGREGATIONS = {"m": "latest", "f": "average"}
PEOPLE_WATERMARKS_S = {"m": 20, "f": 30}

# Settings of the vector job.
DEVICE_VECTORS = {"d0": "v1", "d1": "v1", "d2": "v2,v3"}
VECTOR_WATERMARKS_S = {"v1": 10, "v2": 20, "v3": 30}
VECTOR_FEATURES = {"v1": "f1,f2", "v2": "f3", "v3": "f4"}
FEATURE_STEPS_MS = {"f1": 5000, "f2": 10000, "f3": 5000, "f4": 5000}
FEATURE_AGGREGATIONS = {"f1": "average", "f2": "average", "f3": "latest", "f4": "latest"}

ROW_OVERHEAD_BYTES = 64


@dataclass(frozen=True)
class Lookup:
    """A settings table and its measured size in bytes."""

    frame: DataFrame
    size: int

    @classmethod
    def checked(cls, frame: DataFrame, key: list[str], positive: list[str], table: str) -> Lookup:
        """Written to the shared folder once, then checked and measured by one aggregate."""
        stored = materialise(frame, "settings")
        bad = F.lit(False)
        for name in positive:
            bad = bad | F.col(name).isNull() | (F.col(name) <= 0)
        texts = [f.name for f in stored.schema.fields if f.dataType.typeName() == "string"]
        width = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))
        per_key = stored.groupBy(*key).agg(
            F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.sum(width.cast("bigint")).alias("bytes")
        )
        totals = per_key.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("bad").alias("bad"), F.sum("bytes").alias("bytes"))
        row = totals.head()
        if row.bad:
            raise ValueError(f"{table}: {', '.join(positive)} must be positive")
        if (row.most or 0) > 1:
            raise ValueError(f"{table}: more than one row for a {'/'.join(key)}")
        overhead = ROW_OVERHEAD_BYTES + 8 * len(stored.columns)
        return cls(stored, (row.n or 0) * overhead + (row.bytes or 0))

    @classmethod
    def measure(cls, frame: DataFrame) -> Lookup:
        """A table of which only its rows must differ."""
        return cls.checked(frame, frame.columns, [], "lookup")

    @classmethod
    def of(cls, spark: SparkSession, columns: dict[str, list]) -> Lookup:
        table = pa.table(columns)
        return cls(
            spark.createDataFrame(table),
            table.nbytes + table.num_rows * (ROW_OVERHEAD_BYTES + 8 * table.num_columns),
        )


@dataclass(frozen=True)
class KeySettings:
    """``key -> step_ms, latest, watermark_ms, timeout_ms`` for one-value jobs."""

    keys: Lookup

    @classmethod
    def from_frame(cls, frame: DataFrame) -> KeySettings:
        """From ``(key, step_ms, agg, watermark_s)`` of any size."""
        watermark_ms = F.col("watermark_s").cast("bigint") * F.lit(1000)
        shaped = frame.select(
            "key",
            F.col("step_ms").cast("bigint").alias("step_ms"),
            (F.col("agg") == F.lit(LATEST)).alias("latest"),
            watermark_ms.alias("watermark_ms"),
            watermark_ms.alias("timeout_ms"),
        )
        return cls(Lookup.checked(shaped, ["key"], ["step_ms", "watermark_ms"], "key settings"))

    @classmethod
    def from_maps(
        cls,
        spark: SparkSession,
        steps_ms: dict[str, int] = PEOPLE_STEPS_MS,
        aggregations: dict[str, str] = PEOPLE_AGGREGATIONS,
        watermarks_s: dict[str, int] = PEOPLE_WATERMARKS_S,
        scale: int = 1,
    ) -> KeySettings:
        keys = sorted(steps_ms)
        if set(keys) - set(aggregations) or set(keys) - set(watermarks_s):
            raise ValueError("every key needs a step, an aggregation and a watermark")
        if any(steps_ms[k] <= 0 or watermarks_s[k] <= 0 for k in keys):
            raise ValueError("steps and watermarks must be positive")
        watermarks = [watermarks_s[k] * 1000 * scale for k in keys]
        return cls(
            Lookup.of(
                spark,
                {
                    "key": keys,
                    "step_ms": [steps_ms[k] * scale for k in keys],
                    "latest": [aggregations[k] == LATEST for k in keys],
                    "watermark_ms": watermarks,
                    "timeout_ms": watermarks,
                },
            )
        )


@dataclass(frozen=True)
class VectorSettings:
    """Settings of the vector job.

    ``fan_out``: ``device -> vector, watermark_ms, timeout_ms``, one row per vector;
    ``features``: ``feature -> step_ms, latest``;
    ``members``: ``vector, feature, latest``, the layout of every vector.
    """

    fan_out: Lookup
    features: Lookup
    members: Lookup

    @classmethod
    def from_frames(
        cls,
        device_vector: DataFrame,
        vector_config: DataFrame,
        vector_feature: DataFrame,
        feature_config: DataFrame,
        timeout_ms: int | None = None,
    ) -> VectorSettings:
        """From the four settings tables; a device's vectors may be a comma list.

        ``timeout_ms`` sets one inactivity timeout for all vectors; by default it
        equals the vector's watermark.
        """
        watermark_ms = F.col("watermark_s").cast("bigint") * F.lit(1000)
        vectors = vector_config.select(
            "vector",
            watermark_ms.alias("watermark_ms"),
            (watermark_ms if timeout_ms is None else F.lit(timeout_ms).cast("bigint")).alias("timeout_ms"),
        )
        features = feature_config.select(
            "feature",
            F.col("step_ms").cast("bigint").alias("step_ms"),
            (F.col("agg") == F.lit(LATEST)).alias("latest"),
        )
        vectors = Lookup.checked(vectors, ["vector"], ["watermark_ms", "timeout_ms"], "vector settings").frame
        known = Lookup.checked(features, ["feature"], ["step_ms"], "feature settings")
        members = split_list(vector_feature, "feature").join(known.frame.drop("step_ms"), "feature")
        fan_out = split_list(device_vector, "vector").join(vectors, "vector")
        return cls(
            Lookup.checked(
                fan_out.select("device", "vector", "watermark_ms", "timeout_ms"),
                ["device", "vector"], [], "device vectors",
            ),
            known,
            Lookup.checked(members.select("vector", "feature", "latest"), ["vector", "feature"], [], "vector features"),
        )

    @classmethod
    def from_maps(
        cls,
        spark: SparkSession,
        device_vectors: dict[str, str] = DEVICE_VECTORS,
        watermarks_s: dict[str, int] = VECTOR_WATERMARKS_S,
        vector_features: dict[str, str] = VECTOR_FEATURES,
        steps_ms: dict[str, int] = FEATURE_STEPS_MS,
        aggregations: dict[str, str] = FEATURE_AGGREGATIONS,
        scale: int = 1,
        timeout_ms: int | None = None,
    ) -> VectorSettings:
        """From the map form, every comma list split into rows."""
        routes = [(d, v) for d, names in device_vectors.items() for v in names.split(",")]
        layout = [(v, f) for v, names in vector_features.items() for f in names.split(",")]
        if {v for _, v in routes} - set(watermarks_s) or {f for _, f in layout} - set(aggregations):
            raise ValueError("every vector needs a watermark, every feature an aggregation")
        if any(n <= 0 for n in [*watermarks_s.values(), *steps_ms.values()]):
            raise ValueError("steps and watermarks must be positive")
        watermarks = [watermarks_s[v] * 1000 * scale for _, v in routes]
        names = sorted(steps_ms)
        return cls(
            Lookup.of(
                spark,
                {
                    "device": [d for d, _ in routes],
                    "vector": [v for _, v in routes],
                    "watermark_ms": watermarks,
                    "timeout_ms": watermarks if timeout_ms is None else [timeout_ms] * len(routes),
                },
            ),
            Lookup.of(
                spark,
                {
                    "feature": names,
                    "step_ms": [steps_ms[f] * scale for f in names],
                    "latest": [aggregations[f] == LATEST for f in names],
                },
            ),
            Lookup.of(
                spark,
                {
                    "vector": [v for v, _ in layout],
                    "feature": [f for _, f in layout],
                    "latest": [aggregations[f] == LATEST for _, f in layout],
                },
            ),
        )


def split_list(frame: DataFrame, column: str) -> DataFrame:
    """One row per entry of a comma list."""
    return frame.withColumn(column, F.explode(F.split(F.col(column), ",")))
