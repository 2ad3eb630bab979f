import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tests.llm.conftest import edge_rows
from tidemark.llm import simhash as S
from tidemark.llm.components import components


def plain_fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)] * bool(words)
    ones = [0] * 64
    for part in parts:
        h = xxh64_intdigest(part.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def expected(rows, radius=2):
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius
    ]
    root = roots(range(len(rows)), links)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[k]] = min(doc, least.get(root[k], doc))
    return Counter((doc, f"{prints[k]:016x}", least.get(root[k])) for k, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("parts, tile_rows", [(4, 4096), (4, 3), (8, 4096), (2, 5)])
def test_against_all_pairs(spark, documents, parts, tile_rows):
    frame = spark.createDataFrame(documents, "doc_id bigint, text string")
    found = S.grouped(frame, parts=parts, tile_rows=tile_rows)
    assert Counter(map(tuple, found.collect())) == expected(documents)


def test_edge_cases(spark, edge, empty):
    assert Counter(map(tuple, S.grouped(edge).collect())) == expected([r[:2] for r in edge_rows()])
    assert S.grouped(empty).count() == 0


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_links_of_dense_fingerprints(spark, tile_rows):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(5)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(60)}
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    found = S.links(spark.createDataFrame(signed, "fp bigint"), tile_rows=tile_rows).collect()
    pairs = [(r.a % 2**64, r.b % 2**64) for r in found]
    assert all((a ^ b).bit_count() <= 2 or roots(prints, pairs)[a] == roots(prints, pairs)[b] for a, b in pairs)
    every = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2]
    assert roots(prints, pairs) == roots(prints, every)


def test_forest_keeps_components():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 80, 60), rng.integers(0, 80, 60)
    x, y = S.forest(a, b)
    nodes = range(80)
    assert roots(nodes, zip(a.tolist(), b.tolist())) == roots(nodes, zip(x.tolist(), y.tolist()))
    assert len(x) < len(set(a) | set(b))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(2).shuffle(links)
    found = components(spark.createDataFrame(links, "x bigint, y bigint"))
    nodes = {n for link in links for n in link} - {300}
    assert {r.node: r.root for r in found.collect()} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_keep_one(spark, edge, empty):
    kept = S.keep_one(edge)
    assert kept.columns == edge.columns
    groups = {c for _, _, c in expected([r[:2] for r in edge_rows()])}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(g for g in groups if g is not None)
    assert S.keep_one(empty).count() == 0


def test_keep_one_of_each_component_whatever_the_ids(spark):
    rng = random.Random(8)
    plain = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(7)]
    rows = [(None, plain[0]), (None, plain[1]), (None, plain[1]), (None, plain[2]), (1, plain[2])]  # 2: the null id goes
    rows += [(5, plain[3]), (5, plain[4]), (5, plain[4]), (4, plain[4]), (6, plain[5]), (6, plain[6])]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    want = [(None, 0), (None, 1), (1, 2), (5, 3), (4, 4), (6, 5), (6, 6)]
    assert Counter(map(tuple, kept)) == Counter((i, plain[k]) for i, k in want)
