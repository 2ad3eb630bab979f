"""The registered queries of this folder: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    exact_dedup, fill_middle, language_id, mixing, packing, quality, secrets_scan, simhash, spelling, suffix_dedup, token_files, toxicity, vptree,
)
from tidemark.llm.common import documents, labels, vocabulary


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, folder))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.per_document(documents(spark, folder))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.grouped(documents(spark, folder))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(documents(spark, folder), vocabulary("byte_bpe_50k.json"))


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.search_every(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.classified(docs, *toxicity.fit(docs, labels(spark, folder)))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), vocabulary("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.classified(docs, quality.fit(docs, labels(spark, folder)))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_scan.digests(documents(spark, folder))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # A pattern: a stream may not read a single file by its plain name.
    return exact_dedup.decisions(spark, f"{folder}/documents[.]parquet")


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language_id.identified(docs, *language_id.fit(docs))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(documents(spark, folder))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_language": op11_language,
    "op12_spelling": op12_spelling,
    "op13_fill_middle": op13_fill_middle,
}
