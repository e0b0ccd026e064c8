"""Project configuration as JSON files on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import schema


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration document, a row; an error where the workspace has none. A replacement that was cut short is finished first."""
    if not exists(spark, path) and exists(spark, f"{path}.staged/_SUCCESS"):
        _move(spark, path)
    if not exists(spark, path):
        raise FileNotFoundError(f"no exam blueprint at {path}")
    return spark.read.schema(schema("config")).json(path, multiLine=True)


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes text rows to `path` by way of a staging folder, so that rows read from `path` are whole when it goes."""
    rows.write.mode("overwrite").text(f"{path}.staged")
    _move(spark, path)


def _move(spark: SparkSession, path: str) -> None:
    """Puts the whole staging folder in the place of `path`."""
    staged, target = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.staged", path))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(staged, target):
        raise OSError(f"can't move {path}.staged to {path}")


def write_config(config: DataFrame, path: str) -> None:
    """Replaces the document at `path`."""
    replace(config.sparkSession, config.coalesce(1).select(F.to_json(F.struct(*config.columns), {"ignoreNullFields": "true"}).alias("value")), path)


def write_packet(packet: DataFrame, path: str) -> None:
    """The packet's JSON line as a text file: what a push to each connecting device sends."""
    from ..operators.blueprint import packet_json

    packet_json(packet).coalesce(1).write.mode("overwrite").text(path)
