"""The same results as plain SQL over the ``events`` table, replayed in arrival order."""

from __future__ import annotations

# --- building blocks

EVENT_COLUMNS = """
  event_id, user_id, event_type, value, ts,
  epoch_us(ts) AS ts_us, epoch_us(ts) // 1000 AS ts_ms, arrival_us,
  'd' || (user_id % 3) AS device,
  CASE WHEN user_id % 3 = 0 THEN 'f1' WHEN user_id % 3 = 1 THEN 'f2'
       WHEN event_type IN ('click', 'view', 'error') THEN 'f3' ELSE 'f4' END AS feature,
  CASE WHEN user_id % 2 = 0 THEN 'm' ELSE 'f' END AS sex
"""

# Every 17th reading is late: its event time lies eight hours before its arrival.
MOVED = "CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL 8 HOUR ELSE ts END"


def readings(moved: str = MOVED) -> str:
    return f"""readings AS (
  SELECT {EVENT_COLUMNS} FROM (SELECT * REPLACE ({moved} AS ts), epoch_us(ts) AS arrival_us FROM events))"""


READINGS = readings()

VECTOR_SETTINGS = """
device_vector(device, vector) AS (VALUES ('d0', 'v1'), ('d1', 'v1'), ('d2', 'v2'), ('d2', 'v3')),
vector_config(vector, watermark_ms) AS (VALUES ('v1', 7200000), ('v2', 14400000), ('v3', 21600000)),
vector_feature(vector, feature) AS (VALUES ('v1', 'f1'), ('v1', 'f2'), ('v2', 'f3'), ('v3', 'f4')),
feature_config(feature, step_ms, latest) AS (
  VALUES ('f1', 3600000, false), ('f2', 7200000, false), ('f3', 3600000, true), ('f4', 3600000, true))
"""

VECTOR_ROWS = f"""
{READINGS}, {VECTOR_SETTINGS},
rows_ AS (
  SELECT d.vector AS key, r.feature, r.ts_ms // f.step_ms * f.step_ms AS bucket_ms, r.ts_us,
         r.value, r.arrival_us, r.event_id, m.feature IS NOT NULL AS is_member, f.latest,
         c.watermark_ms
  FROM readings r
  JOIN device_vector d USING (device)
  JOIN vector_config c ON c.vector = d.vector
  JOIN feature_config f ON f.feature = r.feature
  LEFT JOIN vector_feature m ON m.vector = d.vector AND m.feature = r.feature)
"""


def people_rows(event_time: str = "ts", moved: str = MOVED) -> str:
    return f"""
{readings(moved)},
key_config(key, step_ms, latest, watermark_ms) AS (
  VALUES ('m', 3600000, true, 14400000), ('f', 7200000, false, 21600000)),
rows_ AS (
  SELECT r.sex AS key, 'value' AS feature, epoch_us({event_time}) AS ts_us,
         epoch_us({event_time}) // 1000 // c.step_ms * c.step_ms AS bucket_ms,
         floor(r.value) AS value, r.arrival_us, r.event_id, true AS is_member, c.latest,
         c.watermark_ms, c.step_ms
  FROM readings r JOIN key_config c ON c.key = r.sex)
"""


TIED = people_rows("date_trunc('hour', ts)")
PEOPLE = people_rows()
# For the built-in watermark, which drops late rows by micro-batch: no late rows at all.
IN_ORDER = people_rows(moved="ts")

JUDGED = """
judged AS (
  SELECT *, greatest(0, coalesce(max(CASE WHEN is_member THEN bucket_ms END) OVER (
             PARTITION BY key ORDER BY arrival_us, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) - watermark_ms < bucket_ms AS accepted
  FROM rows_),
limits AS (
  SELECT key, greatest(0, max(CASE WHEN is_member THEN bucket_ms END)) - max(watermark_ms) AS limit_ms
  FROM rows_ GROUP BY key),
opened AS (
  SELECT DISTINCT j.key, j.bucket_ms,
         CASE WHEN j.bucket_ms <= l.limit_ms THEN 'closed' ELSE 'timeout' END AS emit_reason
  FROM judged j JOIN limits l USING (key) WHERE accepted)
"""

# Latest value, first arrival winning ties, or mean, of accepted member rows.
VALUES_OF_ACCEPTED = """
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY key, bucket_ms, feature ORDER BY ts_us DESC, arrival_us, event_id) AS rank_
  FROM judged WHERE accepted AND is_member),
values_ AS (
  SELECT key, bucket_ms, feature,
         CASE WHEN any_value(latest) THEN max(CASE WHEN rank_ = 1 THEN value END) ELSE avg(value) END AS value
  FROM ranked GROUP BY key, bucket_ms, feature)
"""

JUDGED_PEOPLE = f"WITH {PEOPLE}, {JUDGED}"
VALUED_PEOPLE = f"{JUDGED_PEOPLE}, {VALUES_OF_ACCEPTED}"


def cells(emitted: str = "emit_reason = 'closed'", opened: str = "opened", rows: str = VECTOR_ROWS) -> str:
    return f"""WITH {rows}, {JUDGED}, {VALUES_OF_ACCEPTED},
cells AS (
  SELECT o.key, o.bucket_ms, m.feature, o.emit_reason, v.value,
         last_value(v.value IGNORE NULLS) OVER (
           PARTITION BY o.key, m.feature ORDER BY o.bucket_ms
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
  FROM (SELECT * FROM {opened} WHERE {emitted}) o
  JOIN vector_feature m ON m.vector = o.key
  LEFT JOIN values_ v ON v.key = o.key AND v.bucket_ms = o.bucket_ms AND v.feature = m.feature)
"""


def closed_windows(limit: str) -> str:
    """Windows ended at or before the watermark; ``limit`` is the set of watermarks per key."""
    return f"""WITH {IN_ORDER},
marks AS (SELECT key, max(ts_us) // 1000 - max(watermark_ms) AS mark_ms FROM rows_ GROUP BY key),
ranked AS (
  SELECT *, ts_us // 1000 // step_ms * step_ms AS window_ms, row_number() OVER (
    PARTITION BY key, bucket_ms ORDER BY ts_us DESC, value DESC) AS rank_ FROM rows_)
SELECT r.key, bucket_ms,
       round(CASE WHEN any_value(latest) THEN max(CASE WHEN rank_ = 1 THEN value END)
                  ELSE avg(value) END, 6) AS value
FROM ranked r JOIN {limit} USING (key)
WHERE window_ms + step_ms <= mark_ms
GROUP BY r.key, window_ms, bucket_ms
"""


ONE_MARK = "(SELECT key, min(mark_ms) OVER () AS mark_ms FROM marks)"

NUMBERED = """
numbered AS (
  SELECT key, bucket_ms,
         CAST(row_number() OVER (PARTITION BY key ORDER BY bucket_ms) - 1 AS INTEGER) AS bucket_index
  FROM opened WHERE emit_reason = 'closed')
"""

STREAMED_VECTORS = f"""{cells()}, {NUMBERED}
SELECT c.key AS vector, c.bucket_ms, n.bucket_index, c.feature, round(c.filled, 6) AS filled
FROM cells c JOIN numbered n USING (key, bucket_ms)
"""

FIRST_ARRIVAL = "ORDER BY ts_us DESC, arrival_us, event_id"
LAST_ARRIVAL = "ORDER BY ts_us DESC, arrival_us DESC, event_id DESC"


def tied_latest(order: str) -> str:
    return f"""WITH {TIED} SELECT key, bucket_ms, value FROM (
SELECT *, row_number() OVER (PARTITION BY key, bucket_ms {order}) AS rank_ FROM rows_) WHERE rank_ = 1"""


def mean_or_latest(rows: str, order: str, counted: bool) -> str:
    return f"""WITH {rows}, ranked AS (
SELECT *, row_number() OVER (PARTITION BY key, bucket_ms {order}) AS rank_ FROM rows_)
SELECT key, bucket_ms, round(CASE WHEN any_value(latest) THEN max(CASE WHEN rank_ = 1 THEN value END)
       ELSE avg(value) END, 6) AS value{", count(*) AS n_rows" if counted else ""}
FROM ranked GROUP BY key, bucket_ms"""


def breaks(order: str, measure: str, out: str) -> str:
    return f"""WITH {VECTOR_ROWS}, steps AS (
SELECT key, {measure} <= lag({measure}) OVER (PARTITION BY key ORDER BY {order}) AS broken FROM rows_)
SELECT key, count(*) AS n_rows, count(*) FILTER (broken) AS {out} FROM steps GROUP BY key"""


MEMBER_OPENED = """
member_opened AS (
  SELECT DISTINCT j.key, j.bucket_ms, 'closed' AS emit_reason
  FROM judged j JOIN limits l USING (key) WHERE accepted AND is_member AND j.bucket_ms <= l.limit_ms)
"""

WHOLE_NUMBER_ROWS = VECTOR_ROWS.replace("r.value,", "floor(r.value) AS value,")

NUMBERED_STREAM = f"""{VALUED_PEOPLE}, {NUMBERED}
SELECT key, bucket_ms, bucket_index, round(v.value, 6) AS value
FROM numbered JOIN values_ v USING (key, bucket_ms)"""

MEMBERS_ONLY = (
    cells(opened="member_opened").replace("\ncells AS", f"{MEMBER_OPENED},\ncells AS")
    + "SELECT key AS vector, bucket_ms, feature, round(filled, 6) AS filled FROM cells"
)

USER_ROWS = """
rows_ AS (
  SELECT user_id AS key, 'value' AS feature, ts_us, value, arrival_us, event_id, true AS is_member,
         user_id % 2 = 0 AS latest,
         CASE WHEN user_id % 2 = 0 THEN 14400000 ELSE 21600000 END AS watermark_ms,
         CASE WHEN user_id % 2 = 0 THEN ts_ms // 3600000 * 3600000
              ELSE ts_ms // 7200000 * 7200000 END AS bucket_ms
  FROM readings)"""

MANY_KEYS = f"""WITH {READINGS}, {USER_ROWS}, {JUDGED}, {VALUES_OF_ACCEPTED}
SELECT o.key, o.bucket_ms, round(v.value, 6) AS value, o.emit_reason
FROM opened o JOIN values_ v USING (key, bucket_ms) WHERE emit_reason = 'closed'
"""


def timed_out(rows: str, timeout_ms: str, cleanup_ms: int) -> str:
    """Buckets of every epoch in ``emitted``, with their run; replayed by windows over whole keys."""
    return f"""WITH {rows},
paused AS (
  SELECT *, coalesce(arrival_us // 1000 - lag(arrival_us // 1000) OVER in_order > {timeout_ms}, false) AS pause
  FROM rows_ WINDOW in_order AS (PARTITION BY key ORDER BY arrival_us, event_id)),
epochs AS (
  SELECT *, CAST(sum(CASE WHEN pause THEN 1 ELSE 0 END) OVER (
    PARTITION BY key ORDER BY arrival_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch
  FROM paused),
judged AS (
  SELECT *, greatest(0, coalesce(max(CASE WHEN is_member THEN bucket_ms END) OVER (
             PARTITION BY key, epoch ORDER BY arrival_us, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) - watermark_ms < bucket_ms AS accepted
  FROM epochs),
ends AS (
  SELECT key, epoch, max(arrival_us) // 1000 + max({timeout_ms}) AS expires_ms,
         epoch < max(epoch) OVER (PARTITION BY key) AS over_
  FROM epochs GROUP BY key, epoch),
opened AS (SELECT DISTINCT key, epoch, bucket_ms, watermark_ms FROM judged WHERE accepted),
closers AS (
  SELECT o.key, o.epoch, o.bucket_ms, min(e.arrival_us) // 1000 AS closed_ms
  FROM opened o JOIN epochs e ON e.key = o.key AND e.epoch = o.epoch AND e.is_member
    AND e.bucket_ms >= o.bucket_ms + o.watermark_ms
  GROUP BY ALL),
due AS (
  SELECT o.key, o.epoch, o.bucket_ms, coalesce(closed_ms, expires_ms) AS emitted_ms,
         CASE WHEN closed_ms IS NULL THEN 'timeout' ELSE 'closed' END AS emit_reason
  FROM opened o JOIN ends USING (key, epoch) LEFT JOIN closers USING (key, epoch, bucket_ms)
  WHERE closed_ms IS NOT NULL OR over_
     OR expires_ms < (SELECT max(arrival_us) // 1000 - 1000 FROM rows_)),
quiet AS (
  SELECT *, coalesce(emitted_ms - lag(emitted_ms) OVER (
    PARTITION BY key ORDER BY emitted_ms, bucket_ms) > {cleanup_ms}, false) AS quiet FROM due),
runs AS (
  SELECT *, sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER (
    PARTITION BY key ORDER BY emitted_ms, bucket_ms ROWS UNBOUNDED PRECEDING) AS run FROM quiet),
emitted AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY key, run ORDER BY emitted_ms, bucket_ms) - 1 AS INTEGER) AS bucket_index FROM runs),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY key, epoch, bucket_ms, feature ORDER BY ts_us DESC, arrival_us, event_id) AS rank_
  FROM judged WHERE accepted AND is_member),
values_ AS (
  SELECT key, epoch, bucket_ms, feature,
         CASE WHEN any_value(latest) THEN max(CASE WHEN rank_ = 1 THEN value END) ELSE avg(value) END AS value
  FROM ranked GROUP BY key, epoch, bucket_ms, feature)
"""


RESTARTED = f"""{timed_out(VECTOR_ROWS, "900000", 3_600_000)}
SELECT e.key AS vector, e.epoch, e.bucket_ms, e.bucket_index, m.feature,
       round(last_value(v.value IGNORE NULLS) OVER (
         PARTITION BY e.key, e.run, m.feature ORDER BY e.emitted_ms, e.bucket_ms
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS filled, e.emit_reason
FROM emitted e JOIN vector_feature m ON m.vector = e.key
LEFT JOIN values_ v ON v.key = e.key AND v.epoch = e.epoch AND v.bucket_ms = e.bucket_ms AND v.feature = m.feature"""

REJECTED = f"""WITH {READINGS}, {VECTOR_SETTINGS}
SELECT event_id, reject_reason FROM (
  SELECT event_id, device,
    CASE WHEN event_id % 13 = 0 THEN 'bad_json' WHEN event_id % 19 = 0 THEN 'unknown_device'
         WHEN event_id % 23 = 0 THEN 'unknown_feature' WHEN event_id % 29 = 0 THEN 'null_field'
    END AS reject_reason FROM readings) r
LEFT JOIN device_vector d ON d.device = r.device AND reject_reason NOT IN ('bad_json', 'unknown_device')
WHERE reject_reason IS NOT NULL"""

OPEN_BUCKETS = f"""WITH {VECTOR_ROWS}, {JUDGED}
SELECT key AS vector, bucket_ms FROM opened WHERE emit_reason = 'timeout'"""

# Every reading is either fit for one or two vectors, or rejected with a reason.
PROGRESS = f"""WITH rejected AS ({REJECTED}), {VECTOR_ROWS}, {JUDGED}
SELECT 'rejects' AS query, reject_reason AS metric, count(*) AS n FROM rejected GROUP BY ALL
UNION ALL SELECT 'rejects', 'fit', count(*) FROM rows_ WHERE event_id NOT IN (SELECT event_id FROM rejected)
UNION ALL SELECT 'rejects', 'rows_read', count(*) FROM events
UNION ALL SELECT 'vectors', 'late', count(*) FROM judged WHERE NOT accepted
UNION ALL SELECT 'vectors', 'closed', count(*) FROM opened WHERE emit_reason = 'closed'"""

LATE_ROWS = f"{JUDGED_PEOPLE} SELECT key, event_id, bucket_ms, value FROM judged WHERE NOT accepted"

SQL = {
    "s2_decode": "SELECT event_id, event_type AS key, props AS json_value FROM events",
    "s3_broker_time": f"""WITH {READINGS}
SELECT event_id, arrival_us, (event_id % 8) * 70368744177664 + event_id AS tie FROM readings""",
    "s4_json_parse": r"""SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k
FROM events""",
    "s5_flatten": f"""WITH {READINGS}
SELECT event_id, feature AS name, device, value, ts_us, false AS bad_json FROM readings""",
    "s6_typed_people": f"""WITH {READINGS}
SELECT event_id, sex AS key, floor(value) AS value, ts_ms // 1000 * 1000 AS ts_ms FROM readings""",
    "q1_rejected": REJECTED,
    "p1_rename": f"WITH {READINGS} SELECT event_id, feature, device, value FROM readings",
    "p2_struct": "SELECT event_id, event_type AS kind, value AS amount FROM events",
    "p3_cast": "SELECT event_id, floor(value) AS age FROM events",
    "p4_key_settings": f"WITH {PEOPLE} SELECT event_id, key, step_ms, latest, watermark_ms FROM rows_",
    "p5_coarse_grain": f"""WITH {READINGS} SELECT event_id, ts_ms, ts_ms // step_ms * step_ms AS bucket_ms FROM (
SELECT event_id, ts_ms - 1705500000000 AS ts_ms,
       CASE WHEN user_id % 2 = 0 THEN 5000 ELSE 10000 END AS step_ms FROM readings)""",
    "p8_fan_out": f"WITH {VECTOR_ROWS} SELECT event_id, key AS vector, feature, bucket_ms FROM rows_",
    "p8_comma_list": f"""WITH {READINGS}
SELECT event_id, unnest(string_split(CASE WHEN device = 'd2' THEN 'v2,v3' ELSE 'v1' END, ',')) AS vector
FROM readings""",
    "p9_one_key": f"WITH {PEOPLE} SELECT event_id, key, value FROM rows_ WHERE key = 'm'",
    "p10_membership": f"WITH {VECTOR_ROWS} SELECT event_id, key AS vector, feature, is_member FROM rows_",
    "p11_na_drop": "SELECT event_id, event_type, value FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
    "p12_messages": f"""{cells(rows=WHOLE_NUMBER_ROWS)}
SELECT key, '{{"bucket":"' || strftime(make_timestamp(bucket_ms * 1000), '%Y-%m-%dT%H:%M:%S') || '.000Z","values":{{'
  || string_agg('"' || feature || '":' || coalesce(CAST(filled AS VARCHAR), 'null'), ',' ORDER BY feature)
  || '}}}}' AS value
FROM cells GROUP BY key, bucket_ms""",
    "a1_window_average": f"""WITH {PEOPLE}
SELECT bucket_ms, round(avg(value), 6) AS value FROM rows_ WHERE key = 'f'
GROUP BY ts_us // 1000 // 7200000, bucket_ms""",
    "a2_window_latest": f"""WITH {TIED} SELECT bucket_ms, value FROM (
SELECT *, row_number() OVER (PARTITION BY bucket_ms ORDER BY ts_us DESC, value DESC) AS rank_
FROM rows_ WHERE key = 'm') WHERE rank_ = 1""",
    "a3_latest_first_arrival": tied_latest(FIRST_ARRIVAL),
    "a4_latest_last_arrival": tied_latest(LAST_ARRIVAL),
    "a5_mean": f"WITH {PEOPLE} SELECT key, bucket_ms, round(avg(value), 6) AS value FROM rows_ GROUP BY ALL",
    "a6_mean_or_latest": mean_or_latest(TIED, FIRST_ARRIVAL, counted=True),
    "a7_assembled": f"{cells()} SELECT key AS vector, bucket_ms, feature, round(value, 6) AS value FROM cells",
    "a8_grouping_keys": f"""WITH {VECTOR_ROWS}
SELECT key, count(*) AS n_rows, count(DISTINCT bucket_ms) AS n_buckets FROM rows_ GROUP BY key""",
    "w1_key_watermarks_stream": closed_windows("marks"),
    "w2_key_windows": closed_windows("marks"),
    "u1_union_stream": closed_windows(ONE_MARK),
    "t1_late_filter": f"""WITH {VECTOR_ROWS}, {JUDGED}
SELECT key AS vector, event_id, bucket_ms, accepted FROM judged""",
    "t2_closed_buckets": f"""{VALUED_PEOPLE}
SELECT key, bucket_ms, round(v.value, 6) AS value, emit_reason
FROM opened JOIN values_ v USING (key, bucket_ms) WHERE emit_reason = 'closed'""",
    "t2_many_keys": MANY_KEYS,
    "t4_flushed_buckets": f"""{VALUED_PEOPLE}
SELECT key, bucket_ms, round(v.value, 6) AS value, emit_reason
FROM opened JOIN values_ v USING (key, bucket_ms)""",
    "t4_timeout_buckets": f"""{timed_out(f"{READINGS}, {USER_ROWS}", "watermark_ms", 86_400_000)}
SELECT key, epoch, bucket_ms, bucket_index, round(v.value, 6) AS value, emit_reason, emitted_ms
FROM emitted JOIN values_ v USING (key, epoch, bucket_ms)""",
    "t4_timeout_stream": RESTARTED,
    "t9_restarted": RESTARTED,
    "t6_quiet_buckets": mean_or_latest(PEOPLE, LAST_ARRIVAL, counted=False),
    "t7_numbered": f"{JUDGED_PEOPLE}, {NUMBERED} SELECT key, bucket_ms, bucket_index FROM numbered",
    "t7_numbered_stream": NUMBERED_STREAM,
    "t7_spread_stream": NUMBERED_STREAM,
    "t8_filled": f"{cells()} SELECT key AS vector, bucket_ms, feature, round(filled, 6) AS filled FROM cells",
    "t8_filled_all": f"""{cells("true")}
SELECT key AS vector, bucket_ms, feature, round(filled, 6) AS filled, emit_reason FROM cells""",
    "t8_members_only": MEMBERS_ONLY,
    "t8_members_stream": MEMBERS_ONLY,
    "t8_members_spread_stream": MEMBERS_ONLY,
    "t8_vectors_stream": STREAMED_VECTORS,
    "t8_spread_stream": STREAMED_VECTORS,
    "t12_chained_stream": STREAMED_VECTORS,
    "t10_arrival_order": breaks("arrival_us, event_id", "ts_us", "n_unsorted"),
    "t10_value_order": breaks("arrival_us, event_id", "value", "n_falling"),
    "t11_late_counts": f"""WITH {VECTOR_ROWS}, {JUDGED}
SELECT key AS vector, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (NOT accepted) AS n_late
FROM judged GROUP BY key""",
    "t11_late_rows": LATE_ROWS,
    "t11_late_rows_stream": LATE_ROWS,
    "t11_late_stream": f"""WITH {VECTOR_ROWS}, {JUDGED}
SELECT key AS vector, bucket_ms, count(*) AS n_late FROM judged WHERE NOT accepted GROUP BY key, bucket_ms""",
    "o3_open_buckets": OPEN_BUCKETS,
    "o3_open_buckets_stream": OPEN_BUCKETS,
    "s13_progress_stream": PROGRESS,
}
