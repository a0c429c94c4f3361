"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.llm import (
    checks_sql,
    cover_tree,
    decontam,
    hard_negatives,
    html_extract,
    language,
    licenses,
    merkle,
    packing,
    personal,
    quality,
    sharding,
    simhash,
    token_counts,
)

#: The shards that the placement query fills.
SHARDS = [f"shard-{k:02d}" for k in range(32)]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file that the packing and counting queries are specified with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(_read(spark, folder, "pages"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_read(spark, folder, "documents")).drop("detections")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.resample(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return language.predict(docs, language.learn(docs))


def op7_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.near_duplicates(_read(spark, folder, "embeddings"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count(token_counts.with_edits(_read(spark, folder, "documents")), tokenizer_path())


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(_read(spark, folder, "documents"), SHARDS)


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op11_personal(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return personal.digest(personal.find(docs, personal.learn(docs)))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = hard_negatives.shifted_labels(_read(spark, folder, "embeddings"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(_read(spark, folder, "documents"), merkle.lowered_text())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_extract,
        op2_simhash,
        op3_licenses,
        op4_packing,
        op5_quality,
        op6_language,
        op7_embeddings,
        op8_token_counts,
        op9_sharding,
        op10_decontaminate,
        op11_personal,
        op12_hard_negatives,
        op13_manifest,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return checks_sql.statements()
