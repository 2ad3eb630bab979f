"""Readings replayed one at a time: the plain meaning the jobs are tested against."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from tidemark.functions.timegrain import arrival


def truncated(ms: int, step: int) -> int:
    return int(ms / step) * step if abs(ms) < 2**50 else ms // step * step


@dataclass
class Replay:
    """One key. ``layout`` maps each member feature to whether it takes the latest value."""

    watermark_ms: int
    layout: dict[str, bool]
    newest: int = 0
    pools: dict = field(default_factory=dict)
    carried: dict = field(default_factory=dict)
    index: int = 0
    late: int = 0

    def feed(self, feature: str, bucket: int, ts_us: int, value: float) -> None:
        if self.newest - self.watermark_ms >= bucket:
            self.late += 1
            return
        pool = self.pools.setdefault(bucket, {})
        if feature in self.layout:
            pool.setdefault(feature, []).append((ts_us, value))
            self.newest = max(self.newest, bucket)

    def emit(self, everything: bool = False) -> list[tuple]:
        """``(bucket, index, feature, value, filled)`` of the buckets due, in order."""
        out = []
        for bucket in sorted(self.pools):
            if not everything and bucket > self.newest - self.watermark_ms:
                break
            pool = self.pools.pop(bucket)
            for feature, latest in sorted(self.layout.items()):
                value = None
                if feature in pool:
                    seen = pool[feature]
                    newest = max(ts for ts, _ in seen)
                    value = (
                        next(v for ts, v in seen if ts == newest)
                        if latest
                        else sum(v for _, v in seen) / len(seen)
                    )
                    self.carried[feature] = value
                out.append((bucket, self.index, feature, value, self.carried.get(feature)))
            self.index += 1
        return out


STEPS = {"f1": 5000, "f2": 10000, "f3": 5000, "f4": 5000}
ROUTES = {"d0": ["v1"], "d1": ["v1"], "d2": ["v2", "v3"]}
WATERMARKS = {"v1": 10_000, "v2": 20_000, "v3": 30_000}
LAYOUTS = {"v1": {"f1": False, "f2": False}, "v2": {"f3": True}, "v3": {"f4": True}}


def replay_vectors(readings: list[tuple], flush: bool = False) -> tuple[list[tuple], dict[str, int]]:
    """``readings`` are ``(name, device, value, ts_us)`` in arrival order.

    Gives ``(vector, bucket, index, feature, value, filled)`` and late counts.
    """
    keys = {v: Replay(WATERMARKS[v], LAYOUTS[v]) for v in WATERMARKS}
    for name, device, value, ts_us in readings:
        for vector in ROUTES[device]:
            bucket = truncated(ts_us // 1000, STEPS[name])
            keys[vector].feed(name, bucket, ts_us, value)
    rows = [(v, *row) for v, key in keys.items() for row in key.emit() + (key.emit(True) if flush else [])]
    return rows, {v: key.late for v, key in keys.items()}


def device_frame(spark, readings: list[tuple]):
    """The same readings as a table, arriving in list order (three at the same time)."""
    rows = [(n, d, float(v), ts, i) for i, (n, d, v, ts) in enumerate(readings)]
    raw = spark.createDataFrame(rows, "name string, device string, value double, ts_us bigint, seq bigint")
    return shaped_devices(raw)


def shaped_devices(raw):
    return raw.select(
        "name",
        "device",
        "value",
        F.timestamp_micros("ts_us").alias("timestamp"),
        arrival(F.floor(F.col("seq") / 3), F.col("seq")).alias("arrival"),
    )


def key_frame(spark, readings: list[tuple]):
    """``(key, value, seconds)`` in arrival order."""
    rows = [(k, float(v), int(s * 1_000_000), i) for i, (k, v, s) in enumerate(readings)]
    raw = spark.createDataFrame(rows, "key string, value double, ts_us bigint, seq bigint")
    return shaped_keys(raw)


def shaped_keys(raw):
    return raw.select(
        "key",
        "value",
        F.timestamp_micros("ts_us").alias("timestamp"),
        arrival(F.lit(0), F.col("seq")).alias("arrival"),
    )


def random_readings(rng, count: int, spread_s: int = 60, start_s: int = 0) -> list[tuple]:
    """Roughly rising event times with stragglers and equal times."""
    out = []
    for i in range(count):
        device = rng.choice(["d0", "d1", "d2"])
        name = {"d0": "f1", "d1": "f2"}.get(device) or rng.choice(["f3", "f4"])
        second = start_s + i + rng.randint(-spread_s, spread_s // 4)
        out.append((name, device, float(rng.randint(0, 50)), second * 1_000_000))
    return out


@dataclass
class IdleReplay(Replay):
    """One key whose timeouts run on the clock of arrivals."""

    timeout_ms: int = 0
    cleanup_ms: int = 0
    last_ms: int | None = None
    emitted_ms: int | None = None
    epoch: int = 0

    def rows(self, at_ms: int, reason: str, everything: bool = False) -> list[tuple]:
        """``(epoch, bucket, index, feature, value, filled, reason, at)`` of what is due at a time."""
        due = any(everything or b <= self.newest - self.watermark_ms for b in self.pools)
        if not due:
            return []
        if self.emitted_ms is not None and at_ms - self.emitted_ms > self.cleanup_ms:
            self.index, self.carried = 0, {}
        self.emitted_ms = at_ms
        return [(self.epoch, *row, reason, at_ms) for row in self.emit(everything)]

    def pass_time(self, now_ms: int) -> list[tuple]:
        """The clock moves on: past the end of the timeout the key is forgotten."""
        if self.last_ms is None or now_ms <= self.last_ms + self.timeout_ms:
            return []
        out = self.rows(self.last_ms + self.timeout_ms, "timeout", everything=True)
        self.newest, self.last_ms, self.epoch = 0, None, self.epoch + 1
        return out

    def arrive(self, at_ms: int, feature: str, bucket: int, ts_us: int, value: float) -> list[tuple]:
        out = self.pass_time(at_ms)
        self.last_ms = at_ms
        self.feed(feature, bucket, ts_us, value)
        return out + self.rows(at_ms, "closed")


def replay_idle(
    readings: list[tuple], timeout_ms: int, cleanup_ms: int, flush: bool = False, delay_ms: int = 0, members: bool = False
) -> list[tuple]:
    """``readings`` are ``(name, device, value, ts_us, arrival_us)`` in arrival order.

    Gives ``(vector, epoch, bucket, index, feature, value, filled, reason, emitted_ms)``.
    """
    keys = {v: IdleReplay(WATERMARKS[v], LAYOUTS[v], timeout_ms=timeout_ms, cleanup_ms=cleanup_ms) for v in WATERMARKS}
    rows = []
    for name, device, value, ts_us, arrival_us in readings:
        for vector in ROUTES[device]:
            if members and name not in LAYOUTS[vector]:
                continue
            bucket = truncated(ts_us // 1000, STEPS[name])
            rows += [(vector, *r) for r in keys[vector].arrive(arrival_us // 1000, name, bucket, ts_us, value)]
    newest = max((r[4] for r in readings), default=0) // 1000
    for vector, key in keys.items():
        rows += [(vector, *r) for r in key.pass_time(newest - delay_ms)]
        if flush and key.last_ms is not None:
            rows += [(vector, *r) for r in key.rows(key.last_ms + timeout_ms, "timeout", everything=True)]
    return rows


def idle_readings(rng, count: int) -> list[tuple]:
    """Random readings with pauses between their arrivals, some of them just as long as a timeout."""
    out, now = [], 1_000_000_000
    for name, device, value, ts_us in random_readings(rng, count, start_s=100):
        now += rng.choice([0, 1, 999, 1000, 20_000, 250_000, 3_000_000, 4_999_000, 5_000_000, 5_001_000, 12_000_000])
        out.append((name, device, value, ts_us, now))
    return out


def idle_frame(spark, readings: list[tuple]):
    rows = [(n, d, float(v), ts, at, i) for i, (n, d, v, ts, at) in enumerate(readings)]
    raw = spark.createDataFrame(rows, "name string, device string, value double, ts_us bigint, at_us bigint, seq bigint")
    return shaped_idle(raw)


def shaped_idle(raw):
    return raw.select(
        "name", "device", "value", F.timestamp_micros("ts_us").alias("timestamp"), arrival(F.col("at_us"), F.col("seq")).alias("arrival")
    )
