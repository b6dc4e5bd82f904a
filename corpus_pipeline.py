"""Corpus pipeline over `documents`: language ID, exact dedup, near-duplicate join, benchmark decontamination, and
SentencePiece encoding.  Each stage is (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsieve.llm import decontaminate, exact_dedup, language_id, near_dups, piece_codec, shared
from logsieve.llm.queries import tokenizer_path
from logsieve.ship import shipped


@shipped
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID accepts."""
    return language_id.accepted(docs, host=F.col("source"))


@shipped
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: that with the largest id."""
    return exact_dedup.without_copies(docs)


@shipped
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each near-duplicate class: that with the least id."""
    return near_dups.one_of_each(docs)


@shipped
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shipped
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded, ids."""
    return piece_codec.encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", token_stage),
]
#: Trained models, MinHash classes and tokenizers have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
