"""A corpus pipeline of four stages: quality filter, near-dedup, mix, pack.

Each stage is a function of (spark, docs, sf_dir) that works on all documents that
the stage before has kept; `run` writes each result and reads it back, so no stage is
worked out twice and each survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventmill.llm import minhash, mixing, packing, quality
from eventmill.llm.queries import WORD_TOKENIZER
from eventmill.session import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the certified cutoffs do not reject."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return minhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them, in its order."""
    return mixing.drawn(docs, stored(mixing.mix(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents in training sequences."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Cutoffs, hashed draws and token ids are not expressible in SQL; tests compare the
# stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
