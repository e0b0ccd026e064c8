"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once inside one Python worker.
SLICE_BYTES = 1_500_000
#: Rows of an Arrow batch between JVM and Python, in the registered queries and the pipeline.
BATCH_ROWS = 1_000


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH_ROWS rows at most: JVM and Python hold a few of them for each task at any time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column` each, one row at least; the column may be a field of `row`."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(values(batch, column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def values(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A column of a batch, or that field of its struct column `row`."""
    if column in batch.schema.names:
        return batch.column(column)
    return pc.struct_field(batch.column("row"), column)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, '' for null."""
    return [x or "" for x in values(batch, column).to_pylist()]


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A hint to broadcast `df` where it has at most `most` rows; larger tables join by shuffle. `df` must be cheap to count."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=out[1:])
    return out


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a temporary one where a local session names none, an error where a cluster's does."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows in a reliable checkpoint: lineage ends there and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, rows: int = 20_000) -> tuple[DataFrame, int]:
    """The rows in a checkpoint, and how many they are: read in a partition for each `rows` of them, so that rounds over little data make few files."""
    out = cut(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // rows))), n


U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
