import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tests.llm.conftest import edge_rows
from tidemark.llm import spelling as S


def words_of(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run) if h % 31 == 0 else None
            found[run if at is None else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    """By definition: some deletion, replacement or insertion at one place turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    n = words_of(rows)
    near = {w: [] for w in n}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        for size in (len(w), len(w) + 1):
            for v in by_length.get(size, ()):
                if (size > len(w) or w < v) and one_edit(w, v):
                    near[w].append(v)
                    near[v].append(w)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n[w], form[w], root(w), len(near[w]), n.get(form[w])) for w in n}


def planted(rng):
    """Words with variants of falling counts, so that forms make chains."""
    rows = []
    for k in range(12):
        word = "".join(rng.choice("abcdeéñÿstr") for _ in range(rng.randrange(6, 12)))
        for times in (2500, 240, 22, 2):
            rows.append((1000 + k, " ".join([word] * times)))
            i = rng.randrange(len(word))
            c = rng.choice("abcdxyz")
            word = rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])
    rows += [(5000, "Ähnlich× ähnlich× ÄHNLICH÷ Straßen strassen STRASSEN straßen strasse strasse")] * 2
    rows += [(6000 + i, ("q" * 3000 + "z") + " " + "q" * 3000 + " " + "q" * 1500 + "x" + "q" * 1500) for i in range(2)]
    return rows


def found(frame, **more):
    return {(r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in S.variants(frame, **more).collect()}


@pytest.mark.parametrize("symbols", [2, 8])
def test_against_all_pairs(spark, documents, symbols):
    rows = documents + planted(random.Random(3))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = expected(rows)
    assert found(frame, symbols=symbols) == want
    assert len({r[3] for r in want if r[2] and r[3] != r[2]}) > 3  # chains


def test_bit_set_changes_nothing(spark, documents, monkeypatch):
    frame = spark.createDataFrame(documents[:60], "doc_id bigint, text string")
    monkeypatch.setattr(S, "LEAST_BITS", 64)
    monkeypatch.setattr(S, "MOST_BITS", 64)
    assert found(frame) == expected(documents[:60])


def test_keys_of_all_edits():
    """The generated keys are those of the strings themselves, for all short reduced words."""
    for n, symbols in ((1, 3), (2, 3), (4, 2), (3, 4)):
        code = np.array(list(product(range(symbols), repeat=n)))
        for row, got in zip(code.tolist(), S.edit_keys(code, symbols).tolist(), strict=True):
            strings = {tuple(row[:i] + row[i + 1 :]) for i in range(n)} | {tuple(row)}
            strings |= {tuple(row[:i] + [c] + row[i + 1 :]) for i in range(n) for c in range(symbols)}
            strings |= {tuple(row[:i] + [c] + row[i:]) for i in range(n + 1) for c in range(symbols)}
            want = {int(S.own_keys(np.array([s], np.int64).reshape(1, -1), symbols)[0]) for s in strings}
            assert set(got) == want


def test_symbols_are_used_alike():
    letters = np.array([[ord(c)] for c in "abcdefghijklmnopqrstuvwxyz"])
    counts = np.bincount(S.reduced(letters, 8).ravel(), minlength=8)
    assert counts.min() >= 2 and counts.max() <= 5


def test_edge_cases(spark, edge, empty):
    assert found(edge) == expected([r[:2] for r in edge_rows()])
    assert S.variants(empty).count() == 0
