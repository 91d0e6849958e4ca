"""A corpus pipeline: quality, near duplicates, benchmark passages, personal data, then ids for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, jaccard, pieces, pii, quality
from lattica.llm._cluster import dropped, shared_dir
from lattica.llm.queries import PIECE_MODEL, findable, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier scores under 0.3."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component linked by a shingle Jaccard similarity of 0.75 or more."""
    findable(spark)
    return jaccard.deduplicated(docs, size=5, percent=75)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the texts."""
    return pii.sanitised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of each text."""
    findable(spark)
    return pieces.encoded(docs, pieces.read_model(spark, PIECE_MODEL))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("PII", remove_personal_data),
    ("SentencePiece encoding", encode),
]

#: Trees, a similarity join's components and Viterbi can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, written between stages to the shared folder; what a stage left goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{k}")
        if k:
            dropped(spark, f"{top}/{k - 1}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
