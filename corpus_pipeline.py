"""From raw documents to an encoded training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
``docs``. Stages work on all rows they get; all but the last return the columns of documents.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from passagework.llm import bpe, cotraining, dart_minhash, pii_anchors, spaced_seeds
from passagework.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the co-trained views call low or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotraining.accept(docs, cotraining.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of exact and near copies."""
    return dart_minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item."""
    return spaced_seeds.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii_anchors.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]

#: The classifier and the merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in [partial(f, spark) for _, f in STAGES]:
        docs = written(stage(docs, sf_dir), "pipeline")
    return docs
