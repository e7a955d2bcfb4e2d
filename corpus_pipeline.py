"""From raw documents to token ids: reject bad and unidentified documents, drop near-copies, mix the sources, encode."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe_stream, kn_langid, mix, ordinal, simhash
from quillgrid.llm.common import deleted, give_back, settled, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express trained models or BPE; tests hold run() against brute force, given the stages' models.
ORACLE_SQL = None


def afresh(stage: Callable) -> Callable:
    """The stage, on executors that have first given back what earlier ones took."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


@afresh
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose grade is 1 or better with probability 0.5 at least."""
    model = ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.kept(docs.select(*COLUMNS), model)


@afresh
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is accepted; learns from the input's own rows that aren't held out."""
    model = kn_langid.train(docs, kn_langid.learned(F.col("doc_id")))
    return kn_langid.kept(docs.select(*COLUMNS), model)


@afresh
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: links between SimHashes of five-word shingles, each verified at similarity 0.8, and
    those that no radius in SimHashes finds."""
    return simhash.one_of_each(docs.select(*COLUMNS))


@afresh
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mix.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


@afresh
def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, their hashes, and whether decoding regains the text."""
    return bpe_stream.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on documents. Each stage's rows are written and read again; tables that no later stage needs
    are deleted once they have been read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark) as made:
        for _, stage in STAGES:
            docs = settled(spark, "stage", lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
            deleted(spark, made[:-1])
            del made[:-1]
        made.clear()
    return docs
