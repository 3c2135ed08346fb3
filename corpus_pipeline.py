"""A corpus pipeline of five stages. Each takes and returns documents; between stages they are written and read again.

The last stage returns the encoded documents. A document that the mixing stage gives twice stands twice from there on.

Null, empty and letterless texts go in the first stage, as they have no language; rows without doc_id pass all stages as they are. Rows that
share a doc_id: the second stage leaves one of them. Very long texts pass whole; an empty table gives an empty result; columns beyond
those of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import language_id, max_plus, mixing, paragraphs, weighted_minhash
from tallyspark.llm.common import release, shared_dir, table

#: None: stages of the pipeline have no SQL form; the tests compare it with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no letters, or a best score below 0.4. Ties keep the document."""
    return language_id.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near-duplicates stays."""
    return weighted_minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go but for their first occurrence (smallest doc_id, then place), with documents that have nothing else."""
    return paragraphs.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their rates for the target weights say; a warning tells if no rates meet the targets."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return max_plus.encoded(docs).select("doc_id", "n_tokens", "round_trip", F.col("ids"))


STAGES = [("language ID", identify_language), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing to target weights", mix), ("SentencePiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            release(docs)
        docs = spark.read.parquet(f"{folder}/{k}")
        docs.scratch_path = f"{folder}/{k}"
    return docs
