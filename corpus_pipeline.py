"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage's output is written as Parquet in the cluster's shared folder and read again
as the next one's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontaminate, line_dedup, minhash, quality, sentencepiece_codec
from gristmill.llm._store import Scratch, ship
from gristmill.llm.queries import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier turn away go."""
    return quality.accepted(spark, docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents of which no word is left."""
    return line_dedup.deduplicated(spark, docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return minhash.deduplicated(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean(spark, docs, _table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    ship(spark)
    return sentencepiece_codec.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        others = Scratch.roots()
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        Scratch.sweep(others)
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
