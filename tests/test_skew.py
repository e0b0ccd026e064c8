"""Joins in which one key has most rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from scoresheet_spark.operators import grading
from scoresheet_spark.operators.skew import join_by_key


@pytest.fixture
def unaided(spark):
    """No broadcasts that the engine decides on, no splitting of partitions by it."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(held, ("-1", "false", "8"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def sizes(df):
    """Rows of each task behind the last join; all columns are read, or the optimizer leaves joins out."""
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*df.columns))).collect()]


def scans(spark, n=60_000):
    """Two thirds of all scans are of one student in one session, some have no session."""
    hot = F.col("id") % 3 > 0
    return spark.range(n).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 31 == 5, None).when(hot, "s").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("session_id"), F.when(hot, "1").otherwise((F.col("id") % 997).cast("string")).alias("student_id"),
        (F.col("id") % 13).cast("double").alias("mcq_score"), F.array(F.lit(1.0)).alias("essay_scores"), (F.col("id") % 13 + 1).cast("double").alias("total_score"), F.array().cast("array<struct<q:int,student_ans:string,correct_ans:string>>").alias("mistakes"),
    )


def test_scans_of_a_hot_pair_are_dealt_to_all_tasks(spark, unaided):
    registry = spark.range(900).select(F.col("id").cast("string").alias("student_id"), F.lit("x").alias("student_name"))
    graded = grading.grade(scans(spark), registry)
    found = sizes(graded)
    assert sum(found) == 60_000 and len(found) == 8 and max(found) <= 2 * statistics.median(found)
    text = graded._jdf.queryExecution().executedPlan().toString()
    assert "_part" in text and "partial_min" in text and "Window" not in text


def test_plain_join_has_the_hot_pair_in_one_task(spark, unaided):
    rows = scans(spark)
    per_key = rows.groupBy("session_id", "student_id").agg(F.min("seq").alias("first"))
    assert max(sizes(rows.join(per_key, ["session_id", "student_id"], "left"))) > 38_000


@pytest.mark.parametrize("n", [0, 1, 500])
def test_join_by_key_equals_a_join(spark, n):
    rows = spark.range(n).select(F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    per_key = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    expected = rows.join(per_key.drop("n"), ["a", "b"], "left")
    got = join_by_key(rows, per_key, ["a", "b"], "n", F.col("seq"))
    assert sorted(got.columns) == sorted(expected.columns)
    order = sorted(got.columns)
    assert sorted(map(repr, got.select(order).collect())) == sorted(map(repr, expected.select(order).collect()))
