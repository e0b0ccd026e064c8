"""Schemas of tables, documents and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMAS = {
    "registry": "student_id STRING NOT NULL, student_name STRING NOT NULL",
    "sessions": "session_id STRING, exam_name STRING, exam_type STRING, has_essays BOOLEAN, essay_config ARRAY<STRUCT<q_num:INT,max:DOUBLE>>, answer_key ARRAY<STRUCT<q:INT,ans:STRING,weight:DOUBLE>>, roi_coordinates STRUCT<x:INT,y:INT,w:INT,h:INT>, created_at TIMESTAMP",
    "grades": "scan_id BIGINT, session_id STRING, student_id STRING, mcq_score DOUBLE, essay_total DOUBLE, final_score DOUBLE, mistakes_log STRING, timestamp TIMESTAMP",
    "roster": "student_id STRING NOT NULL, student_name STRING NOT NULL, is_present INT, group_name STRING",
    "submission": "session_id STRING, student_id STRING, mcq_score DOUBLE, essay_scores ARRAY<DOUBLE>, total_score DOUBLE, mistakes ARRAY<STRUCT<q:INT,student_ans:STRING,correct_ans:STRING>>",
    "response": "seq BIGINT, status STRING, error_type STRING, total_score DOUBLE, previous_score DOUBLE, message STRING",
    "config": "project_name STRING, mode STRING, mcq_count INT, mcq_points DOUBLE, has_essays BOOLEAN, essay_points_map MAP<STRING,DOUBLE>, template_path STRING, roi_coordinates STRUCT<x:INT,y:INT,w:INT,h:INT>",
    "class_names": "class_id INT, name STRING",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    """The table before anything is in it."""
    return spark.createDataFrame([], schema(name))


def create_store(spark: SparkSession, database: str | None = None, names: tuple[str, ...] = ("registry", "sessions", "grades", "roster")) -> None:
    """Parquet tables of the store where they don't exist yet."""
    prefix = f"{database}." if database else ""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in names:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({SCHEMAS[name].replace(' NOT NULL', '')}) USING parquet")


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views of tables by name, for `query`."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, text: str, **values: object) -> DataFrame:
    """A SQL query with named parameters (`:group`), which are bound and never pasted into the text."""
    return spark.sql(text, args=values)
