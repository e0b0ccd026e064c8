"""Places in an ordered list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grading import numbered


def ordinals(rows: DataFrame, order: str, width: int = 1_000_000) -> DataFrame:
    """`rows` with ordinal (1, 2, ...) and total, by a unique integer column."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return numbered(rows, order, "ordinal", width).crossJoin(F.broadcast(total))
