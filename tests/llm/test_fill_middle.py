import hashlib
import random
import re
from collections import Counter

import pytest

from tests.llm.conftest import edge_rows
from tidemark.llm import fill_middle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc, text, rate=100, share=50):
    """The contract line by line, without chunks."""
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, len(lines), "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < share else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, len(lines), form, len(p), len(m), sha(out), sha(text)


def hard_texts():
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("ab é🎉ñ<PSM>\r\v \x85") for _ in range(n))
    texts = ["\n", "\n\n\n", "a", "a\n", "\na", "é", "🎉\n🎉", "<", "<P", "x<P>y", "<S>", "a\n<M>\nb", "< P>", "<p>"]
    texts += ["\n".join(line(rng.randrange(60)).replace(">", "") for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["🎉" * 30_000, "é" * 50_000 + "\n" + "é" * 9, "\n" * 40_000, "ab\n" * 60_000, "x" * 200_000]
    shared = "\n".join(line(50).replace(">", "") for _ in range(200))
    texts += [shared, "before\n" + shared, shared + "\nafter"]
    return texts


def test_against_the_contract(spark, documents):
    rows = documents + list(enumerate(hard_texts(), 100_000))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = Counter(map(tuple, M.digests(frame).collect()))
    assert found == Counter(plain(*r) for r in rows)


@pytest.mark.parametrize("rate, share", [(0, 50), (40, 0), (70, 100)])
def test_rates(spark, documents, rate, share):
    frame = spark.createDataFrame(documents, "doc_id bigint, text string")
    found = M.transformed(frame, rate=rate, suffix_first=share).collect()
    got = {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output)) for r in found}
    assert got == {plain(*d, rate, share)[:6] for d in documents}


def test_chunks_hold_the_text_and_never_cut_characters():
    for text in hard_texts():
        parts = list(M.chunks(text.encode()))
        assert b"".join(parts) == text.encode()
        for part in parts:
            part.decode()
            assert 0 < len(part) <= M.MOST
        assert all(len(p) >= M.LEAST or len(p) > M.MOST - 4 for p in parts[:-1])


def test_shared_passages_give_the_same_chunks():
    rng = random.Random(2)
    shared = bytes(rng.randrange(32, 127) for _ in range(40_000))
    one = set(M.chunks(b"short start " + shared))
    other = set(M.chunks(bytes(rng.randrange(32, 127) for _ in range(777)) + shared + b" end"))
    common = sum(map(len, one & other))
    assert common > 35_000


def test_blocks_change_no_chunk(monkeypatch):
    text = "\n".join(hard_texts()).encode()
    whole = list(M.chunks(text))
    monkeypatch.setattr(M, "BLOCK", 1000)
    assert list(M.chunks(text)) == whole


@pytest.mark.parametrize("least, most", [(3, 7), (1, 4), (2, 50)])
def test_sums_and_cuts_for_any_chunk(monkeypatch, least, most):
    """Markers and line ends at every place of a chunk."""
    monkeypatch.setattr(M, "LEAST", least)
    monkeypatch.setattr(M, "MOST", max(most, 4))
    monkeypatch.setattr(M, "CHUNK_BITS", 1)
    memo = M.Memo(200)
    for text in [t for t in hard_texts() if len(t) < 3000] + ["a" * i + "<M>" + "b" * 9 for i in range(30)]:
        raw = text.encode()
        whole = M.Text(raw, memo)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert whole.lines == len(lines) and whole.marked == M.has_marker(raw)
        for k in range(len(lines) + 1):
            part = "".join(lines[:k])
            assert whole.cut(k) == (len(part.encode()), len(part))
        assert memo.size <= 200 + 50


def test_memo_compares_contents():
    class Clash(bytes):
        def __hash__(self):
            return 1

    memo = M.Memo()
    assert memo.summary(Clash(b"a\n")).lines == 1 and memo.summary(Clash(b"abc")).lines == 0
    assert memo.summary(b"a\n") is memo.summary(b"a" + b"\n")


def test_edge_cases(spark, edge, empty):
    assert Counter(map(tuple, M.digests(edge).collect())) == Counter(plain(*r[:2]) for r in edge_rows())
    assert M.digests(empty).count() == 0
