import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import edge_rows
from tidemark.llm import suffix_dedup as S


def expected(rows, length=400, keep="none"):
    """By window counts: (bytes, removed, runs, SHA-256 of the rest) by row number."""
    data = [(k, (t or "").encode()) for k, t in rows]
    count, seen, out = Counter(), set(), {}
    for _, b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            window = b[i : i + length]
            if window in seen if keep == "first" else count[window] > 1:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def made_up():
    rng = random.Random(5)
    rnd = lambda n: "".join(rng.choice("abcdefghijk ") for _ in range(n))
    short, long = rnd(399), rnd(520)
    rows = [rnd(300) + short + rnd(200) + "é" + long + rnd(rng.randrange(500)) for _ in range(25)]
    rows += [rnd(300)[:i] + short + "x" + rnd(3) for i in range(8)]
    rows += ["a" * 3000, "ab" * 700, "xyz " * 500 + "ab" * 300, None, "", "q" * 400, "q" * 401, rows[0], rows[0][:700]]
    return list(enumerate(rows))


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [8192, 5])
def test_against_counting_all_windows(spark, keep, crowd):
    rows = made_up()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in S.digests(frame, keep=keep, crowd=crowd).collect()}
    assert found == expected(rows, keep=keep)


def test_against_counting_on_a_table(spark, documents):
    frame = spark.createDataFrame(documents, "doc_id bigint, text string")
    found = {r.doc_id: tuple(r)[1:] for r in S.digests(frame).collect()}
    assert found == expected(documents)


def test_edge_cases(spark, edge, empty):
    rows = [(k, r[1]) for k, r in enumerate(edge_rows())]
    want = expected(rows)
    found = Counter((r.doc_id, *tuple(r)[1:]) for r in S.digests(edge).collect())
    assert found == Counter((r[0], *want[k]) for k, r in enumerate(edge_rows()))
    assert S.digests(empty).count() == 0


def test_kept_text_is_what_is_left(spark):
    passage = "".join(random.Random(1).choices("abcdef", k=450))
    rows = [(1, "head " + passage), (2, passage + " tail"), (3, "alone")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = {r.doc_id: bytes(r.kept) for r in S.cleaned(frame).collect()}
    assert first == {1: ("head " + passage).encode(), 2: b" tail", 3: b"alone"}
    none = {r.doc_id: bytes(r.kept) for r in S.cleaned(frame, keep="none").collect()}
    assert none == {1: b"head ", 2: b" tail", 3: b"alone"}


def test_blocks_do_not_change_pieces(monkeypatch):
    text = "".join(random.Random(2).choices("ab ", k=9000)).encode()
    windows = lambda: {
        (int(s) + i) for _, _, _, s, n, st, t in zip(*S.pieces_of([text]), strict=True)
        for k in range(t) for i in range(k * st, k * st + n - 399)
    }
    assert windows() == set(range(len(text) - 399))
    monkeypatch.setattr(S, "BLOCK", 1000)
    assert windows() == set(range(len(text) - 399))


@pytest.mark.parametrize("seed", range(8))
def test_longest_previous_factors_by_definition(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab" if seed % 2 else b"abcd") for _ in range(rng.randrange(1, 60)))
    common = lambda i, j: next((k for k in range(len(text) - max(i, j)) if text[i + k] != text[j + k]), len(text) - max(i, j))
    order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
    lcp = np.array([0] + [common(a, b) for a, b in zip(order[:-1], order[1:], strict=True)])
    found = dict(zip(order.tolist(), S.longest_previous_factor(order, lcp).tolist(), strict=True))
    assert found == {i: max((common(i, j) for j in range(i)), default=0) for i in range(len(text))}


def test_prefix_ranks_order_by_bytes():
    rng = np.random.default_rng(1)
    data = np.concatenate((rng.integers(97, 99, 300, dtype=np.uint8), np.zeros(40, np.uint8)))
    width, ranks = S.prefix_ranks(data, 40)[-1]
    ranks = ranks[:300]
    assert width == 40
    prefixes = [data[i : i + 40].tobytes() for i in range(300)]
    order = {p: k for k, p in enumerate(sorted(set(prefixes)))}
    dense = {r: k for k, r in enumerate(sorted(set(ranks.tolist())))}
    assert [dense[r] for r in ranks.tolist()] == [order[p] for p in prefixes]


@pytest.mark.parametrize("seed", range(6))
def test_factors_by_definition(seed):
    """Longest earlier and later match of every window, over pieces of several texts."""
    rng = random.Random(seed)
    length = rng.choice([9, 20, 37, 64])
    passages = [bytes(rng.choices(b"ab" if seed % 2 else b"abcdef", k=60)) for _ in range(3)]
    contents = [bytes(rng.choices(b"ab", k=rng.randrange(30))) + rng.choice(passages)[rng.randrange(9) :] + b"#" * 13 for _ in range(7)]
    entries = np.array(sorted(rng.choices(range(7), k=4) + list(range(7))))
    alone = S.factors([contents[i] for i in entries], length)
    assert all(np.array_equal(x, y) for x, y in zip(alone, S.factors(contents, length, entries), strict=True))
    piece, place, earlier, later = S.factors(contents, length)
    windows = [(p, i, contents[p][i : i + length]) for p in range(len(contents)) for i in range(len(contents[p]) - length + 1)]
    assert list(zip(piece.tolist(), place.tolist(), strict=True)) == [w[:2] for w in windows]
    common = lambda x, y: next((k for k in range(length) if x[k] != y[k]), length)
    for k, (_, _, w) in enumerate(windows):
        assert earlier[k] == max((common(w, v) for *_, v in windows[:k]), default=0)
        assert later[k] == max((common(w, v) for *_, v in windows[k + 1 :]), default=0)


def test_the_arrays_decide(monkeypatch):
    """A class that was counted twice loses nothing if the factor arrays know of no match."""
    text = bytes(random.Random(7).choices(b"abcdef", k=450))
    names = ["fp", "doc", "body", "a", "hash", "n", "content"]
    leads = pa.RecordBatch.from_arrays([pa.array([v]) for v in (1, 5, 6, 0, 9, 2, text)], names=names)
    ranges = lambda: [r for b in S._sort_suffixes(iter([leads]), 400, "none") for r in b.to_pylist()]
    assert [(r["content"], r["later"], r["a"], r["b"]) for r in ranges()] == [(9, False, 0, 450), (9, True, 0, 450)]
    factors = S.factors
    monkeypatch.setattr(S, "factors", lambda *a: tuple(x * (k < 2) for k, x in enumerate(factors(*a))))
    assert ranges() == []


@pytest.mark.parametrize("crowd", [8192, 2])
def test_first_of_repeated_rows_stays(spark, crowd):
    passage = "".join(random.Random(3).choices("abcdef", k=900))
    rows = [(1, passage), (1, passage), (1, passage), (2, "x" + passage), (None, "y" * 50), (None, "y" * 50), (3, "ab" * 400), (3, "ab" * 400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = sorted((r.doc_id or 0, bytes(r.kept)) for r in S.cleaned(frame, keep="first", crowd=crowd).collect())
    assert found == sorted(
        [(1, passage.encode()), (1, b""), (1, b""), (2, b"x"), (0, b"y" * 50), (0, b"y" * 50), (3, b"ab"), (3, b"")]
    )


@pytest.mark.parametrize("top", [1, 3, 1000, 2**40, 2**52, 2**63])
def test_keys_sorted_with_their_places(top):
    """The same order whether a key fits beside its place in 64 bits or not."""
    rng = np.random.default_rng(top % 97)
    key = np.r_[rng.integers(0, top, 4000, np.uint64), np.uint64(top - 1), np.uint64(0)]
    order, ranked = S._sorted(key, "stable")
    want = np.argsort(key, kind="stable")
    assert (order == want).all() and (ranked == key[want]).all()
    assert (S._dense(key) == np.unique(key, return_inverse=True)[1]).all()
    assert [len(x) for x in S._sorted(key[:0])] == [0, 0] and len(S._dense(key[:0])) == 0
