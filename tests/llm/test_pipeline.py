import hashlib

import numpy as np
import pandas as pd

import corpus_pipeline as P
from tests.llm import test_simhash, test_tokens
from tidemark.llm import mixing, quality
from tidemark.llm import word_ids as W
from tidemark.llm.common import vocabulary


def test_stages_against_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs.toPandas().sort_values("doc_id")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        path = str(tmp_path / f"{k}")
        out.write.parquet(path)
        if name == "packing":
            break
        assert out.columns == list(kept.columns), name
        got = spark.read.parquet(path).toPandas().sort_values("doc_id")
        if name == "quality":
            labels = pd.read_parquet(f"{folder}/labels.parquet")
            model = quality.fit(docs, spark.createDataFrame(labels))
            scores = quality.score(model, [t.encode() for t in kept.text])
            want = kept[scores >= quality.THRESHOLD].doc_id.tolist()
        elif name == "exact_dedup":
            want = sorted(kept.groupby("text").doc_id.max())
        elif name == "near_dedup":
            rows = list(zip(kept.doc_id, kept.text, strict=True))
            want = sorted({c for _, _, c in test_simhash.expected(rows)})
        else:
            taken = mixing.per_document(docs).toPandas().set_index("doc_id")
            want = []
            for i, n in zip(kept.doc_id, kept.text.str.split(), strict=True):
                times = taken.taken[i] // len(n) if len(n) else got.doc_id.tolist().count(i)
                want += [i] * int(times)
        assert got.doc_id.tolist() == want, name
        docs, kept = spark.read.parquet(path), got
    rows = spark.read.parquet(path).collect()
    tokenizer = W.load(vocabulary("word_bpe_49k.json"))
    ids = test_tokens.ids_of(tokenizer, kept.text.tolist(), 1)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert {r.doc_id for r in rows} == set(kept.doc_id)


def test_run_of_empty_tables(spark, tmp_path, folder):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_reruns_agree(spark, folder):
    def digest():
        rows = P.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").toPandas()
        rows = rows.sort_values(list(rows.columns)).to_numpy(np.int64)
        return hashlib.sha256(rows.tobytes()).hexdigest()

    assert digest() == digest()
