import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import edge_rows
from tidemark.llm import packing, queries, token_files
from tidemark.llm import word_ids as W
from tidemark.llm.common import vocabulary

ODD = [
    "", " ", "\n", "a", " a", "a ", "\na", "a\n\nb", "a  b", "a \n b", "x\ty", "don't stop, it's O'Neil's 42nd!!  ",
    "<|endoftext|> hi", "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext|", "<|end oftext|>", "naïve café Ünïcode ǅ Σίσυφος ΣΑΣ", "日本語 テスト 🎉🎉 á ́b", "İstanbul ŉ", "a b",
    "1234 5,6.7", "hello.\nWorld", "é" * 400, "éa É,", "\x1c a\x1cb",
]
KINDS = [("byte_bpe_50k.json", 0, True), ("word_bpe_49k.json", 1, False)]


def ids_of(tokenizer, texts, end):
    return [[*x.ids, end] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name, end, blanks", KINDS)
def test_ids_equal_those_of_whole_texts(documents, name, end, blanks):
    texts = ODD + [t for _, t in documents]
    random.Random(1).shuffle(texts)
    coder, plain = W.WordIds(vocabulary(name), end, blanks, most_pieces=2000), Tokenizer.from_file(vocabulary(name))
    for at in range(0, len(texts), 40):
        ids, counts = coder.encode(texts[at : at + 40])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == ids_of(plain, texts[at : at + 40], end)


@pytest.mark.parametrize("name, end, blanks", KINDS)
def test_ids_around_every_kind_of_white_space(name, end, blanks):
    rare = ["\0", "\x7f", "\u180e", "\u200b", "\ufeff", "\u024f", "\u0250", "×", "÷", "ŉ", "İ", "'", "’", "_", "9"]
    marks = [*(chr(c) for c in range(0x11000) if chr(c).isspace()), *rare]
    texts = [t for m in marks for t in (m, f"ab{m}Cd", f"ab {m}cd,", f"ab{m} cd", f"{m}ab.\ncd{m}", f"ab\n{m}cd\n", f"Ab!{m}\nx")]
    coder, plain = W.WordIds(vocabulary(name), end, blanks), Tokenizer.from_file(vocabulary(name))
    for _ in range(2):  # the second time all pieces are known
        ids, counts = coder.encode(texts)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == ids_of(plain, texts, end)
    ids, counts = coder.encode([])
    assert len(ids) == len(counts) == 0


@pytest.mark.parametrize("name, end, blanks", KINDS)
def test_library_gets_each_new_word_once_and_nothing_else(name, end, blanks):
    coder, got = W.WordIds(vocabulary(name), end, blanks), []

    class Listening:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            found = self.tokenizer.encode_batch_fast(texts, **options)
            got.extend(n for x in found for n in x.ids)
            return found

    coder.tokenizer = Listening(coder.tokenizer)
    words = [a + b for a in ("ab", "zor", "quen", "éta") for b in ("lim", "xo", "rasch", "þing")]
    plain = Tokenizer.from_file(vocabulary(name))
    texts = [" " + " ".join(words), " ".join(["", *words[::-1], words[0]])]
    coder.encode(texts)
    once = [" " + w for w in words] + ["\n"] * blanks  # a text that begins with a blank: its first piece is a line feed
    assert sorted(got) == sorted(n for x in plain.encode_batch(once, add_special_tokens=False) for n in x.ids)
    got.clear()
    coder.encode(texts)
    assert not got


@pytest.mark.parametrize("percentile", [0, 50, 90, 100])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 3000):
        for most in (1, 2, 300, 2**16, 2**32):
            ids = rng.integers(0, most, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.05] = most - 1
            blocks = token_files.pack_blocks(ids, percentile)
            sizes = [min(512, n - 512 * i) for i in range(len(blocks))]
            back = [token_files.unpack_block(b, 0, s) for b, s in zip(blocks, sizes, strict=True)]
            assert np.array_equal(np.concatenate([*back, np.zeros(0, np.uint32)]), ids)


def test_reader_decodes_any_range(tmp_path):
    rng = np.random.default_rng(4)
    ids, counts = rng.integers(0, 50257, 5000).astype(np.uint16), np.array([10, 0, 2990, 2000])
    with open(tmp_path / "x", "wb") as out:
        writer = token_files.Writer(out)
        writer.add(np.array([1, 2, 3, 4]), ids, counts)
        writer.add(np.array([9]), ids[:7], np.array([7]))
        writer.close()
    reader = token_files.Reader((tmp_path / "x").read_bytes())
    assert reader.doc_ids.tolist() == [1, 2, 3, 4, 9] and reader.ends.tolist() == [10, 10, 3000, 5000, 5007]
    everything = np.concatenate((ids, ids[:7]))
    for a, b in [(0, 5007), (0, 0), (511, 513), (3000, 5000), (5000, 5007), (1024, 1536)]:
        assert np.array_equal(reader.ids(a, b), everything[a:b])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_of_a_table(spark, folder, documents):
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    expected, start = set(), 0
    for (doc, _), ids in zip(documents, ids_of(plain, [t for _, t in documents], 0), strict=True):
        expected.add((doc, start, len(ids), crc(ids)))
        start += len(ids)
    found = queries.op4_token_files(spark, folder).collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_token_files_of_edge_cases(spark, edge, empty):
    path = vocabulary("byte_bpe_50k.json")
    found = token_files.round_trip(edge, path).collect()
    rows = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    all_ids = ids_of(Tokenizer.from_file(path), [r[1] or "" for r in rows], 0)
    starts = np.cumsum([0] + [len(i) for i in all_ids])
    expected = [(r[0], int(s), len(i), crc(i)) for r, s, i in zip(rows, starts, all_ids, strict=False)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert token_files.round_trip(empty, path).count() == 0


def check_packing(rows, expected_ids):
    """Pieces cover each document once, sequences are gapless and need no padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in expected_ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length])) and r.length > 0
            at += r.length
        assert at == len(ids)
    assert set(by_doc) == set(expected_ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
        assert len({(r.tier, r.step_id) for r in members}) == 1


def test_packing_of_a_table(spark, folder, documents):
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = ids_of(plain, [t for _, t in documents], 1)
    rows = queries.op7_packing(spark, folder).collect()
    check_packing(rows, {d: i for (d, _), i in zip(documents, ids, strict=True)})
    steps = {}
    for r in rows:
        steps[r.step_id] = steps.get(r.step_id, 0) + r.length
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_packing_of_edge_cases(spark, edge, empty):
    path = vocabulary("word_bpe_49k.json")
    numbered = [(k, r[1]) for k, r in enumerate(edge_rows())]
    frame = spark.createDataFrame(numbered, "doc_id bigint, text string").repartition(4)
    ids = ids_of(Tokenizer.from_file(path), [t or "" for _, t in numbered], 1)
    check_packing(packing.packed(frame, path).collect(), dict(enumerate(ids)))
    assert packing.packed(edge, path).where("doc_id IS NULL").count() >= 2
    assert packing.packed(empty, path).count() == 0


def test_packing_does_not_depend_on_what_is_encoded_at_once(spark, folder, monkeypatch):
    docs, path = spark.read.parquet(f"{folder}/documents.parquet"), vocabulary("word_bpe_49k.json")
    whole = packing.packed(docs, path).collect()
    monkeypatch.setattr(packing, "ENCODE_CHARS", 1000)
    assert packing.packed(docs, path).collect() == whole


@pytest.mark.parametrize("seed", range(5))
def test_pack_fills_every_tier(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 100, 256, 257, 500, 1024, 1500, 2047, 2048, 2049, 9000]) for _ in range(rng.randrange(1, 200))]
    covered = {i: [] for i in range(len(lengths))}
    for tier, pieces in packing.pack(lengths):
        assert sum(n for _, _, n in pieces) == tier
        for doc, start, n in pieces:
            covered[doc].append((start, n))
    for doc, parts in covered.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[doc]
