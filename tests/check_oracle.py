"""Compare every registered query with its SQL: ``python tests/check_oracle.py [folder] [name ...]``."""

from __future__ import annotations

import glob
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
from tidemark.session import build_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, name: str, folder: str) -> str | None:
    """None when the query and its SQL give the same columns and rows."""
    frame = spark_entry.queries()[name](spark, folder)
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    answer = connection.execute(spark_entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    expected = table(names, answer.fetchall())
    if got == expected:
        return None
    extra = [r for r in got if r not in set(expected)][:3]
    missing = [r for r in expected if r not in set(got)][:3]
    return f"{len(got)} rows against {len(expected)}; extra {extra}; missing {missing}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("check", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in sys.argv[2:] or spark_entry.queries():
        start = time.time()
        try:
            problem = differences(spark, name, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    sys.exit(bool(failed))
