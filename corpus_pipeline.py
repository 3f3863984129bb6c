"""Corpus pipeline: each stage works on all that the one before kept, written as Parquet and read again.

Stage functions take (spark, docs, sf_dir). All but the last return the columns of `documents`; the last adds the pieces' ids.
An empty table gives an empty table. Rows with a null id, and repeated rows, are rows like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import exact_dedup, langid, mixing, near_dedup, spm
from inkveil.llm.common import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too), and those that noise explains better than any set of languages."""
    return langid.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest id of each group of equal texts; null and empty texts are equal, a null id is the smallest, and of repeated rows one stays."""
    return exact_dedup.deduplicated(docs, keep="largest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of similar texts; texts without words are in no class with others that have any."""
    return near_dedup.deduplicated(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the calibrated probability of their source, language and topic; nulls are values of their own, and equal ids are kept or left out together within a cell."""
    return mixing.sampled(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and checks that decoding gives them back; null and empty texts have no pieces. Keeps every row."""
    return spm.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing", source_mixture),
    ("sentencepiece", sentencepiece),
]

#: SQL has no mixture inference, consistent sampling or piece lattice: tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
