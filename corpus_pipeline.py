"""A corpus from raw documents to token ids, in stages that each read what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm import bpe, decontaminate, line_dedup, quality, simhash
from airloom.session import settled

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are more than their host's boilerplate, without the boilerplate."""
    good = quality.keep_good(docs)
    return good.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that others repeat; n_chars follows the text."""
    cut = line_dedup.drop_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (little-endian unsigned 32-bit), and whether decoding gives the text again."""
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "text"])
    plain = bpe.decode(coded, RANKS)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return plain.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("byte_bpe", byte_bpe),
]

#: Token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
