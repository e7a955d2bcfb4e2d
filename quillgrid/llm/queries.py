"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_stream, kn_langid, license_join, media_sniff, merkle, mix, oracles, ordinal, simhash, token_records, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_records.record_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "file", "offset", "length")


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(_table(spark, sf_dir, "documents")).drop("changed_at")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_langid.identify(_table(spark, sf_dir, "documents"))


def op8_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sniff.stored_and_examined(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed_sizes(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
