import numpy as np
import pytest

from tidemark.llm import vptree as V


def plain(ids, vectors, k, every=20):
    out = set()
    for i, q in zip(ids, vectors, strict=True):
        if i % every == 0:
            scores = V.exact_products(np.repeat(q[None], len(ids), axis=0), vectors)
            ranked = sorted((-s, j) for s, j in zip(scores.tolist(), ids, strict=True) if j != i)[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(ranked, 1)}
    return out


def frame(spark, ids, vectors):
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)


def run(spark, ids, vectors, k=5, shard=64, leaf=8, factor=1.0):
    rows = V.usable(frame(spark, ids, vectors))
    trees, facts = V.index(rows, shard, leaf)
    queries = rows.where("vec_id % 20 = 0")
    return {tuple(r) for r in V.nearest(trees, facts, queries, k, factor, query_rows=7).collect()}


@pytest.mark.parametrize("kind", ["normal", "clustered", "copies", "lengths"])
def test_exact_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    n = 300
    vectors = rng.standard_normal((n, 6))
    if kind == "clustered":
        vectors = rng.standard_normal((5, 6))[rng.integers(0, 5, n)] + 0.01 * vectors
    elif kind == "copies":
        vectors = np.where(rng.random((n, 1)) < 0.5, vectors[0], np.round(vectors))
        vectors[(vectors == 0).all(axis=1)] = 1
    elif kind == "lengths":
        vectors *= 10 ** rng.uniform(-3, 3, (n, 1))
    ids = rng.permutation(1000)[:n].tolist()
    assert run(spark, ids, vectors) == plain(ids, vectors, 5)


def test_relaxed_search_visits_less_and_keeps_recall():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((20, 8))[rng.integers(0, 20, 2000)] + 0.1 * rng.standard_normal((2000, 8))
    largest = np.sqrt((vectors**2).sum(axis=1)).max()
    rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))
    tree, ids = V.build(np.column_stack((vectors, rest)), 32), np.arange(2000)
    exact = V.search(tree, ids, vectors, largest, ids[:100], vectors[:100], 10)
    relaxed = V.search(tree, ids, vectors, largest, ids[:100], vectors[:100], 10, factor=1.2)
    want, got = set(zip(*map(list, exact[:2]), strict=True)), set(zip(*map(list, relaxed[:2]), strict=True))
    assert len(want & got) >= 0.9 * len(want)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "x"), (1, [0.0, 0.0], "x"), (2, None, "x"), (3, [nan, 1.0], "x"), (4, [1.0, None], "x"),
        (5, [inf, 0.0], "x"), (None, [1.0, 1.0], "x"), (6, [0.5, 0.5], None), (6, [0.5, 0.5], "y"), (7, [2.0], "x"),
        (20, [-1.0, 0.0], "x"), (8, [], "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    found = {tuple(r) for r in V.search_every(table, k=20).collect()}
    assert found == {
        (0, 1, 7, 2.0), (0, 2, 6, 0.5), (0, 3, 20, -1.0), (20, 1, 6, -0.5), (20, 2, 0, -1.0), (20, 3, 7, -2.0)
    }
    assert V.search_every(table.where("false")).count() == 0
    assert V.search_every(table.where("vec_id = 0")).count() == 0
