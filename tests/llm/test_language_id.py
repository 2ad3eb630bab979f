import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import edge_rows
from tidemark.llm import language_id as L
from tidemark.llm import queries

TABLES = "/root/testdata/sf0.01"


def aside(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_symbols(text, order):
    """By words: letters and marks in lower case, a blank after each, blanks before; empty without a letter."""
    kind = [unicodedata.category(c)[0] for c in text.lower()]
    if "L" not in kind:
        return ""
    words = "".join(c if k in "LM" else " " for c, k in zip(text.lower(), kind, strict=True)).split()
    return " " * (order - 1) + "".join(w + " " for w in words)


class Plain:
    """Interpolated Kneser-Ney by the formula, from dictionaries."""

    def __init__(self, texts, order, n_symbols):
        self.order, self.n_symbols = order, n_symbols
        top = Counter()
        for t in texts:
            s = plain_symbols(t, order)
            top.update(s[i : i + order] for i in range(len(s) - order + 1))
        self.levels = {order: top}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.total, self.types, self.d = defaultdict(int), defaultdict(int), {}
        for k, level in self.levels.items():
            n1, n2 = (sum(n == x for n in level.values()) for x in (1, 2))
            self.d[k] = (n1 + 0.5) / (n1 + 2 * n2 + 1)
            for g, n in level.items():
                self.total[k, g[:-1]] += n
                self.types[k, g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / self.n_symbols
        total = self.total.get((k, gram[:-1]), 0)
        if not total:
            return self.p(gram[1:])
        rest = self.d[k] * self.types[k, gram[:-1]] / total
        return max(self.levels[k].get(gram, 0) - self.d[k], 0) / total + rest * self.p(gram[1:])

    def log(self, text):
        s = plain_symbols(text, self.order)
        n = max(0, len(s) - self.order + 1)
        return n, sum(math.log(self.p(s[i : i + self.order])) for i in range(n))


def corpus(rng, n=60):
    syllables = {"aa": ["ka", "ti", "no", "re", "é"], "bb": ["sch", "ung", "ti", "ö", "er"], "cc": ["ла", "ти", "но", "é"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 30)))
        rows.append((i, text.title() + rng.choice(["", ".", " 12!", "\n\n"]), lang))
    return rows


PROBES = ["ka ti", "schung", "нола é", "q", "Xyz 日本", "é ́", "", " 1 ", "Ti", "kati" * 50, "İİ"]


@pytest.mark.parametrize("order, most_bytes", [(3, 1 << 26), (5, 1 << 26), (5, 20_000)])
def test_probabilities_against_the_formula(spark, order, most_bytes):
    rows = corpus(random.Random(order))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    trained = L.train(frame, order, most_bytes)
    assert trained.languages == ["aa", "bb", "cc"] and (trained.shards > 1) == (most_bytes < 1 << 26)
    seen = {c for _, t, _ in rows for c in plain_symbols(t, order)}
    models = [Plain([t for _, t, x in rows if x == lang], order, len(seen) + 1) for lang in trained.languages]
    probes = PROBES + [t for _, t, _ in rows[:20]]
    asked = spark.createDataFrame([*enumerate(probes), (None, None), (3, probes[3])], "doc_id bigint, text string")
    found = L.measured(asked, trained).collect()
    assert len(found) == len(probes) + 2
    for r in found:
        text = "" if r.doc_id is None else probes[r.doc_id]
        want = [m.log(text) for m in models]
        assert r["size"] == want[0][0]
        assert np.allclose(r.logs, [w for _, w in want], rtol=1e-5, atol=1e-4)


def test_models_are_distributions():
    """What the formula gives to all symbols after any context, the unknown one included, adds up to one."""
    rows = corpus(random.Random(1))
    texts = [t for _, t, x in rows if x == "aa"]
    seen = {c for t in texts for c in plain_symbols(t, 4)}
    model = Plain(texts, 4, len(seen) + 1)
    for context in ("   ", "ka ", "zzz", " ti", "éka"):
        assert math.isclose(sum(model.p(context + c) for c in [*seen, "\0"]), 1)


def test_windows_of_large_alphabets():
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(300)) for _ in range(30)] + ["", "a"]
    points, sizes = L.symbols(texts, 5)
    starts, text = L.windows(sizes, 5)
    number, rows = L.distinct(points, starts, 5)
    want = [plain_symbols(t, 5)[i : i + 5] for t in texts for i in range(len(plain_symbols(t, 5)) - 4)]
    got = ["".join(map(chr, rows[k])) for k in number]
    assert got == want and len(rows) == len(set(want))
    assert np.bincount(text, minlength=len(texts)).tolist() == [max(0, len(plain_symbols(t, 5)) - 4) for t in texts]


def test_long_texts_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 50)
    rows = corpus(random.Random(4))
    trained = L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 4)
    models = trained.models(0)
    text = " ".join(t for _, t, _ in rows)
    size, logs = models.sums([text], 0, 1)
    parts = [models.sums([text[i : i + 50]], 0, 1) for i in range(0, len(text), 50)]
    assert size[0] == sum(s[0] for s, _ in parts) and np.allclose(logs, sum(x for _, x in parts))


def test_rising_shares():
    got = L.rising(np.array([1.0, 9, 3, 10]), np.array([10.0, 10, 10, 10]))
    assert np.allclose(got, [0.1, 0.6, 0.6, 1.0])


def test_held_out_accuracy_and_rejection(spark):
    found = queries.op11_language(spark, TABLES).toPandas().set_index("doc_id")
    truth = pd.read_parquet(f"{TABLES}/documents.parquet").set_index("doc_id")
    assert len(found) == len(truth) and found.score.between(0, 1).all()
    assert (found.held_out == [aside(i) for i in found.index]).all()
    both = found.join(truth)
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.99
    assert both.accepted[both.held_out].mean() > 0.95


def test_held_out_rows_teach_nothing(spark):
    rows = pd.read_parquet(f"{TABLES}/documents.parquet")[["doc_id", "text", "lang"]]
    moved = rows.copy()
    out = moved.doc_id.map(aside)
    moved.loc[out, "lang"] = "xx"
    results = []
    for table in (rows, moved):
        docs = spark.createDataFrame(table)
        results.append(L.identified(docs, *L.fit(docs)).orderBy("doc_id").toPandas())
    assert results[0].equals(results[1])


def test_strange_texts_are_rejected(spark):
    rng = random.Random(9)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    strange = ["".join(rng.choice("абвгдежзиклмнопрстуфхцчшщ ") for _ in range(400)) for _ in range(20)]
    strange += ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)) for _ in range(20)]
    asked = spark.createDataFrame(list(enumerate(strange)), "doc_id bigint, text string")
    found = L.identified(asked, *L.fit(docs)).collect()
    assert not any(r.accepted for r in found) and {r.lang_pred for r in found} <= {"en", "de", "fr", "es"}


def test_edge_cases(spark, edge, empty):
    trained, calibration = L.fit(edge)
    found = L.identified(edge, trained, calibration).collect()
    assert len(found) == len(edge_rows())
    by_text = Counter((r.doc_id, r.lang_pred == "und") for r in found)
    want = Counter((r[0], not any(c.isalpha() for c in r[1] or "")) for r in edge_rows())
    assert by_text == want
    assert all(r.score == 0 and not r.accepted and r.bits is None for r in found if r.lang_pred == "und")
    nothing = L.fit(empty)
    assert L.identified(empty, *nothing).count() == 0
    assert {r.lang_pred for r in L.identified(edge, *nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        L.train(edge, 2)
