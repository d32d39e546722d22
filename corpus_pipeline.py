"""From raw documents to packed training sequences: five operators, each on all that its predecessor kept.

All stages but the last return the columns of docs, whatever extra ones there are and however they are named. Null and empty texts have the
intercept's quality score, no near-duplicates and no private data, count no words, and are packed as one end id. A null doc_id is kept
and never a near-duplicate. Of repeated rows the near-duplicates stage keeps one. Ties: a score at the threshold is accepted; of a group of
near-duplicates the least doc_id stays. Texts are read whole at any length. An empty table gives an empty result at every stage. Each
stage's table is written into the shared folder, so what a lost executor held is read or computed again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrel.llm import minhash, mixing, packing, pii, quality
from quarrel.llm.common import scratch_dir
from quarrel.llm.tokens import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at a similarity of 0.8 or more."""
    return minhash.deduplicated(docs, percent=80)


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, private data in its text masked."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks for."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, words=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("private data", mask_private_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Models, hashes and a tokenizer decide, which SQL cannot express; tests/llm/test_pipeline.py holds the near-duplicates against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
