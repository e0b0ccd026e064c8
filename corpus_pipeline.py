"""A corpus pipeline in five stages, each with one operator of the llm subpackage.

Every stage works on all rows that its predecessor kept; all but the last return the columns of documents.
A stage gives a frame with no rows for no rows, and passes nulls and further columns on as its operator does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoresheet_spark.llm.bpe import vocabulary
from scoresheet_spark.llm.common import bounded, shared_dir, table
from scoresheet_spark.llm.neardup import keep_first
from scoresheet_spark.llm.packing import END_ID, SEQUENCE_TOKENS, WORD_BPE, pack_documents
from scoresheet_spark.llm.quality import keep_documents
from scoresheet_spark.llm.secrets import redact
from scoresheet_spark.llm.substring import dedup_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs."""
    return keep_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents hold."""
    return dedup_substrings(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return pack_documents(docs, vocabulary(WORD_BPE), SEQUENCE_TOKENS, END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL does not express tokens, signatures or chunks.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet in the shared folder and read again.

    A stage's folder goes once the next one has been written; the last one's stays.
    """
    base = f"{shared_dir(bounded(spark))}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
