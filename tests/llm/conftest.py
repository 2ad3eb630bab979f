import random

import pytest

# Columns that no operator knows, with names that operators use for their own.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "size bigint, keep_id bigint, fp bigint, target double, start bigint, kept boolean"
)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    base = words(rng, 300)
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One TWO\vthree\ffour"), (6, base), (7, base), (7, base),
        (8, base + " tail"), (9, base.upper()), (10, words(rng, 40_000)), (11, "ab" * 3000), (12, "é🎉 " * 200),
        (13, "x" * 30_000), (None, "without id"), (None, None), (14, "one"), (15, "password = 'Ab3dE6gH9' and more"),
        (16, "trailing  blanks \n\n and\ttabs  "),
    ]
    sources = ["a", "b", None, "a", ""]
    return [
        (i, t, [None, "en", "de"][k % 3], sources[k % 5], None, 1, 2, 3, 4.0, 5, True) for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text or "") for r in rows]
