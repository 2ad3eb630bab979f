import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.check_oracle import differences
from tests.llm.conftest import SCHEMA, edge_rows
from tidemark.llm import exact_dedup, mixing


def written(frame, tmp_path, files=3):
    path = str(tmp_path / "documents.parquet")
    frame.repartition(files).write.parquet(path)
    return path


@pytest.mark.parametrize("name", ["op2_mixing", "op10_exact_dedup", "op5_nearest"])
def test_query_equals_sql(spark, folder, name):
    assert differences(spark, name, folder) is None


def expected_groups(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept_yet = False
        for i in sorted(ids, key=lambda i: (i is not None, i)):
            kept = i == keep and not kept_yet
            kept_yet |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_groups_of_edge_cases(spark, edge, tmp_path, files_per_batch):
    path = written(edge, tmp_path)
    found = exact_dedup.decisions(spark, path, files_per_batch=files_per_batch)
    assert Counter(map(tuple, found.collect())) == expected_groups(edge_rows())


def test_stores_are_opened_for_one_read_only(spark, edge, tmp_path, monkeypatch):
    """The state is read once into a table; neither the checks for hits nor the result read it again."""
    opened, read = spark.sparkContext.accumulator(0), exact_dedup.entries

    def counted(part):
        opened.add(1)
        return part

    def entries(spark, state):
        known = read(spark, state)
        return known.mapInArrow(counted, known.schema)

    monkeypatch.setattr(exact_dedup, "entries", entries)
    found = exact_dedup.decisions(spark, written(edge, tmp_path))
    assert Counter(map(tuple, found.collect())) == expected_groups(edge_rows())
    assert opened.value == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_digest_collisions_are_found_by_full_bytes(spark, edge, tmp_path):
    def weak(text):
        return F.unhex(F.substring(F.sha2(text, 256), 1, 1))

    found = exact_dedup.decisions(spark, written(edge, tmp_path), digest=weak)
    assert Counter(map(tuple, found.collect())) == expected_groups(edge_rows())


def test_state_goes_on_where_it_ended(spark, edge, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    rows = edge.where("doc_id IS NOT NULL")
    rows.where("doc_id < 7").write.parquet(path)
    exact_dedup.fold(spark, path, state)
    before = {r.keep_id: r.group_size for r in exact_dedup.entries(spark, state).collect()}
    assert before[6] == 1
    rows.where("doc_id >= 7").write.mode("append").parquet(path)
    found = exact_dedup.decisions(spark, path, state=state)
    expected = expected_groups([r for r in edge_rows() if r[0] is not None])
    assert Counter(map(tuple, found.collect())) == expected


def test_keep_one_keeps_columns_and_empty_tables(spark, edge, empty):
    kept = exact_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({r[1] or "" for r in edge_rows()})
    assert exact_dedup.keep_one(empty).count() == 0


def test_targets_stop_at_the_cap_and_share_the_excess(spark):
    rows = [(i, "w " * n, None, s, *[None] * 7) for i, (s, n) in enumerate([("a", 100), ("b", 1), ("c", 1), (None, 98)])]
    sizes = mixing.sized(spark.createDataFrame(rows, SCHEMA))
    found = {r.source: (r.source_size, r.target) for r in mixing.targets(sizes).collect()}
    # b and c stop at 3; the others (weights 1 and 1, null last: 4th, so weight 1 again) share 194.
    assert found == {"a": (100, 97.0), "b": (1, 3.0), "c": (1, 3.0), None: (98, 97.0)}


def test_mix_of_edge_cases(spark, edge, empty):
    rows = mixing.per_document(edge).collect()
    assert len(rows) == len(edge_rows()) and mixing.per_document(empty).count() == 0
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.per_document(edge.repartition(5)).collect()))
    copies = mixing.mixed_documents(edge)
    assert copies.columns == edge.columns
    taken = sum(r.taken for r in rows)
    assert copies.select(F.sum(mixing.n_words(F.coalesce("text", F.lit(""))))).head()[0] == taken
    assert mixing.mixed_documents(empty).count() == 0


def test_taken_words_come_near_the_targets(spark, folder):
    rows = mixing.per_document(spark.read.parquet(f"{folder}/../sf0.01/documents.parquet"))
    by_target = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most"))
    found = by_target.collect()
    largest, budget = sum(r.most for r in found), sum(r.target for r in found)
    for r in found:
        cut = 1 + largest / budget
        least = 1 - max(x.most for x in found) / budget
        assert r.target * least - r.most <= r.taken <= r.target * cut


def test_buckets_do_not_change_the_mix(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = sorted(map(tuple, mixing.per_document(docs).collect()))
    for rows, slices in [(7, 4096), (7, 5), (1, 2)]:
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
        monkeypatch.setattr(mixing, "BLOCK_SLICES", slices)
        assert sorted(map(tuple, mixing.per_document(docs).collect())) == one
