"""Folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under the session's checkpoint folder; a temporary one where a local session names none, an error where a cluster's does."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or os.path.join(tempfile.gettempdir(), 'scoresheet')}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows in a reliable checkpoint: what made them, such as a model, runs once however often they are read."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
