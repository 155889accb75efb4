"""The corpus pipeline: quality, toxicity, near-duplicates, mixing and encoding, each stage on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, quality, simhash, toxicity
from quire.llm.common import read, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many texts of their source share."""
    kept = quality.keep_good(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not scored as toxic."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_harmless(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one that names it."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row of the mix; a document that it takes twice has two rows."""
    made = bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
    return made.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality), ("toxicity", keep_harmless), ("simhash_dedup", keep_one_of_each), ("mixing", mix_sources), ("bpe", encode),
]

#: Fingerprints, learnt scores and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
