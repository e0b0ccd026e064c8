"""What the plans must show: pushed filters, pruned columns, sums before shuffles."""

import re

from pyspark.sql import functions as F

from scoresheet_spark.operators import detect, grading, labels, roster
from scoresheet_spark.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "roster")
    fx.roster(spark, SF).withColumn("unused", F.lit("x")).write.partitionBy("is_present").parquet(path)
    stored = spark.read.parquet(path)
    text = plan(roster.export(stored, "BUILDING"))
    assert re.search(r"PushedFilters: \[IsNotNull\(group_name\), EqualTo\(group_name,BUILDING\)", text)
    assert "unused" not in text
    assert "PartitionFilters: [isnotnull(is_present" in plan(stored.filter("is_present = 1"))
    assert re.search(r"ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>", plan(grading.unknown_references(fx.order_scans(spark, SF).select("seq", "student_id"), fx.registry(spark, SF), "student_id", "student_id")))


def test_winners_are_found_by_sums_before_the_shuffle(spark):
    text = plan(grading.grade(fx.order_scans(spark, SF), fx.registry(spark, SF)))
    assert "partial_min" in text and "Window" not in text and "Cartesian" not in text
    text = plan(roster.last_wins(fx.imports(spark, SF)))
    assert "partial_max" in text and text.count("Exchange hashpartitioning") == 1 and "Window" not in text


def test_detection_shuffles_once_and_runs_no_python(spark):
    text = plan(detect.decode_raw(fx.raw_grid(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 1 and not re.search("Python|Pandas|Arrow", text)
    assert "Exchange" not in plan(detect.decode_end_to_end(fx.final_rows(spark, SF, 7)))


def test_unlabelled_is_an_anti_join(spark):
    images = spark.createDataFrame([("a.jpg",)], "path string")
    assert "LeftAnti" in plan(labels.unlabelled(images, spark.createDataFrame([("a.txt", 1)], "label_path string, length long")))
