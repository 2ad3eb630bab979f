"""From raw documents to packed training sequences, in five stages.

1. ``quality``: documents that the byte network scores below its threshold go.
2. ``exact_dedup``: of equal texts the document with the largest id stays.
3. ``near_dedup``: of documents whose SimHash fingerprints (three-word shingles) differ in
   two bits or fewer, directly or through others, the one with the smallest id stays.
4. ``mixing``: documents are dropped or repeated (up to three times) towards the sources'
   target weights.
5. ``packing``: what is left is packed into sequences of at most 2048 tokens.

Each stage takes ``(spark, docs, folder)`` and gives a DataFrame that is written to the
shared folder and read again as the next one's ``docs``; all but the last give documents
with all their columns. Every stage works on whole texts of all rows it gets. Edge cases
are those of the stages' operators; an empty table passes through all of them.

Two stages have no SQL form (a trained network, a tokenizer), so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, packing, quality, simhash
from tidemark.llm.common import documents, labels, vocabulary
from tidemark.session import materialise


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, labels(spark, folder)))


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.keep_one(docs, simhash.SHINGLE, simhash.RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    # Workers of this stage share the executors' memory with what earlier stages have left.
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), most_pieces=400_000)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``."""
    docs = documents(spark, folder)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, folder), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
