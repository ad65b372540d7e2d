"""Preparation of a training corpus: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm.common import materialise
from logweave.llm.minhash import keep_representatives
from logweave.llm.packing import pack_documents
from logweave.llm.quality import fit_resampling, keep_target_like
from logweave.llm.toxicity import fit_toxicity, is_held_out, keep_ordinary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression-distance classifier does not reject.

    It is fitted on labelled rows of the documents given. Rows with null or empty text stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_ordinary(docs, fit_toxicity(docs, labels.where(~is_held_out())))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps, with models of the documents given.

    Null and empty texts weigh as much as average ones; rows of equal id share their noise;
    ties with the last one taken stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_target_like(docs, fit_resampling(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that of the smallest id.

    Rows of one id are one document and stay together; rows without an id stay.
    """
    return keep_representatives(docs, words=5, similarity=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of at most 2048 tokens.

    A null or empty text is one piece, its end id; repeated rows are packed each; an empty
    table gives no piece.
    """
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("packing", packing)]

#: Compression, tokenizers and sketches are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, applied to the documents below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
