import pytest

import __spark_entry__ as spark_entry
from tests.check_oracle import differences
from tidemark.catalog import batch, sql, streams

FOLDER = "/root/testdata/sf0.001"
OWN = {*batch.QUERIES, *streams.QUERIES}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, name):
    assert differences(spark, name, FOLDER) is None


def test_every_query_has_sql():
    assert OWN == set(sql.SQL) and OWN <= set(spark_entry.queries())
    assert {name: spark_entry.oracle_sql()[name] for name in OWN} == sql.SQL


def test_entry(spark):
    frame = spark_entry.entry(spark)
    assert frame.columns == ["vector", "bucket_ms", "feature", "filled"] and frame.count() > 0
