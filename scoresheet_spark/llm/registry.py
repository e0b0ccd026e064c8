"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, divergence, langid, neardup, packing, quality, secrets, substring, token_files, topk, url_filter
from .common import bounded

MODULES = (bpe, packing, url_filter, neardup, secrets, quality, chat, langid, topk, substring, token_files, alignment, divergence)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(bounded(spark), sf_dir)


def queries() -> dict:
    return {k: _bounded(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
