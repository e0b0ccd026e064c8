"""Inputs of the named queries, projected from the driver's tables; each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered students: the customers of all segments but one, so that unknown ids occur."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'")
    return c.select(F.col("c_custkey").cast("string").alias("student_id"), F.col("c_name").alias("student_name"))


REGISTRY_SQL = "registry AS (SELECT CAST(c_custkey AS VARCHAR) AS student_id, c_name AS student_name FROM customer WHERE c_mktsegment <> 'MACHINERY')"


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An imported sheet with untidy headers and cells."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("\t"), F.col("c_custkey").cast("string"), F.lit(" "))).alias(" ID "),
        F.concat(F.lit("  "), "c_name", F.lit(" \n")).alias("Name"),
        F.when(F.col("c_nationkey") < 7, "1").when(F.col("c_nationkey") < 13, " 1 ").when(F.col("c_nationkey") < 19, "0").alias("S6"),
        F.col("c_mktsegment").alias("Segment"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored roster: segments are groups, some students have a blank group or none."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("student_id"),
        F.col("c_name").alias("student_name"),
        F.when(F.col("c_acctbal") > 1000, 1).otherwise(0).alias("is_present"),
        F.when(F.col("c_nationkey") == 3, "").when(F.col("c_nationkey") != 5, F.col("c_mktsegment")).alias("group_name"),
    )


ROSTER_SQL = """roster AS (SELECT CAST(c_custkey AS VARCHAR) AS student_id, c_name AS student_name,
  CAST(CASE WHEN c_acctbal > 1000 THEN 1 ELSE 0 END AS INTEGER) AS is_present,
  CASE WHEN c_nationkey = 3 THEN '' WHEN c_nationkey <> 5 THEN c_mktsegment END AS group_name FROM customer)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of many imports, in order: students come again under other groups."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("student_id"), F.concat(F.lit("Student "), "o_custkey").alias("student_name"), F.lit(1).alias("is_present"), F.col("o_orderpriority").alias("group_name"), F.col("o_orderkey").alias("seq"))


IMPORTS_SQL = "imports AS (SELECT CAST(o_custkey AS VARCHAR) AS student_id, 'Student ' || o_custkey AS student_name, CAST(1 AS INTEGER) AS is_present, o_orderpriority AS group_name, o_orderkey AS seq FROM orders)"


def order_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with few repeats."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("session_id"), F.col("o_custkey").cast("string").alias("student_id"),
        F.floor("o_totalprice").cast("double").alias("mcq_score"), F.array(F.lit(2.5), F.lit(3.0)).alias("essay_scores"),
        (F.floor("o_totalprice") + 5.5).cast("double").alias("total_score"),
        F.array(F.struct(F.lit(1).alias("q"), F.lit("A").alias("student_ans"), F.lit("B").alias("correct_ans"))).alias("mistakes"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, payload): JSON messages out of events; some lack lists, some a score."""
    return event_messages(table(spark, sf_dir, "events"))


def event_messages(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    essays = F.when(F.col("value") < 5, "").when(F.col("value") < 10, ',"essay_scores":null').when(F.col("value") < 15, ',"essay_scores":[]').otherwise(F.concat(F.lit(',"essay_scores":['), F.floor("value").cast("string"), F.lit(",0.5]")))
    score = F.when(F.col("value") < 1, "null").otherwise(k.cast("string"))
    errors = F.when(F.col("value") >= 20, F.concat(F.lit(',"mistakes":[{"q":'), k.cast("string"), F.lit(',"student_ans":"A","correct_ans":"C"},{"q":7,"student_ans":null,"correct_ans":"D"}]'))).otherwise("")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit('{"action":"submit","session_id":"'), "event_type", F.lit('","student_id":"'), "user_id", F.lit('","mcq_score":'), score, essays, F.lit(',"total_score":'), (k + 1).cast("string"), errors, F.lit("}")).alias("payload"),
    )


SCANS_SQL = """scans AS (SELECT event_id AS seq, event_type AS session_id, CAST(user_id AS VARCHAR) AS student_id,
  CASE WHEN value >= 1 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS mcq_score,
  CASE WHEN value >= 15 THEN floor(value) + 0.5 ELSE 0.0 END AS essay_total,
  CASE WHEN value >= 15 THEN 2 ELSE 0 END AS n_essays,
  CASE WHEN value >= 20 THEN 2 ELSE 0 END AS n_mistakes,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS total_score FROM events)"""


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("class_id"), F.col("r_name").alias("name"))


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path): a path for each document, with one of eight extensions, one of which is no image's."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    extensions = F.array(*(F.lit(x) for x in ("jpg", "JPEG", "png", "bmp", "tif", "tiff", "webp", "gif")))
    return d.select("doc_id", F.concat(F.lit("/images/"), F.coalesce("source", F.lit("none")), F.lit("/page "), F.col("doc_id").cast("string"), F.lit("."), F.get(extensions, F.pmod(F.col("doc_id"), F.lit(8)).cast("int"))).alias("path"))


PATHS_SQL = """paths AS (SELECT doc_id, '/images/' || coalesce(source, 'none') || '/page ' || doc_id || '.' ||
  (['jpg', 'JPEG', 'png', 'bmp', 'tif', 'tiff', 'webp', 'gif'])[CAST(doc_id % 8 AS INTEGER) + 1] AS path FROM documents)"""

#: Vectors whose anchors make one image.
VECTORS_PER_IMAGE = 25


def raw_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor rows (image_id, width, height, anchor_id, v): eight of each vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    e = e.select("vec_id", "f", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r"))
    f = lambda i: F.get("f", F.col("r") * 8 + i)
    v = F.array(320 + 800 * f(0), 320 + 800 * f(1), 60 + 100 * F.abs(f(2)), 60 + 100 * F.abs(f(3)), *(4 * F.abs(f(i)) for i in range(4, 8)))
    return e.select(F.floor(F.col("vec_id") / VECTORS_PER_IMAGE).cast("bigint").alias("image_id"), F.lit(640).alias("width"), F.lit(640).alias("height"), (F.col("vec_id") * 8 + F.col("r")).cast("bigint").alias("anchor_id"), v.alias("v"))


GRID_SQL = f"""grid AS (SELECT CAST(vec_id // {VECTORS_PER_IMAGE} AS BIGINT) AS image_id, CAST(vec_id * 8 + r AS BIGINT) AS anchor_id,
  320 + 800 * f0 AS cx, 320 + 800 * f1 AS cy, 60 + 100 * abs(f2) AS w, 60 + 100 * abs(f3) AS h, 4 * abs(f4) AS obj,
  4 * abs(f5) AS c0, 4 * abs(f6) AS c1, 4 * abs(f7) AS c2
  FROM (SELECT vec_id, r, {", ".join(f"CAST(embedding[CAST(r AS INTEGER) * 8 + {i + 1}] AS DOUBLE) AS f{i}" for i in range(8))}
        FROM embeddings, range(8) t(r))),
candidates AS (SELECT image_id, anchor_id, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2,
  CAST(CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS INTEGER) AS class_id, obj * greatest(c0, c1, c2) AS score
  FROM grid WHERE obj > 0.25 AND obj * greatest(c0, c1, c2) > 0.25)"""


def final_rows(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """End-to-end rows of 7 or 6 fields, out of the vectors' slices, for images of 800 by 600."""
    n = 9 if width == 7 else 10
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    e = e.select("vec_id", "f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("r"))
    f = lambda i: F.get("f", F.col("r") * width + i)
    box = [320 + 600 * f(0), 320 + 600 * f(1), 320 + 600 * f(0) + 30 + 200 * F.abs(f(2)), 320 + 600 * f(1) + 200 * f(3)]
    v = [F.lit(0.0), *box, 20 * F.abs(f(4)), 4 * F.abs(f(5))] if width == 7 else [*box, 4 * F.abs(f(5)), 20 * F.abs(f(4))]
    return e.select(F.col("vec_id").alias("image_id"), F.lit(800).alias("width"), F.lit(600).alias("height"), F.col("r").alias("anchor_id"), F.array(*v).alias("v"))


def final_sql(width: int) -> str:
    n = 9 if width == 7 else 10
    return f"""SELECT vec_id AS image_id, CAST(r AS INTEGER) AS anchor_id, 320 + 600 * f0 AS x1, 320 + 600 * f1 AS y1,
  320 + 600 * f0 + 30 + 200 * abs(f2) AS x2, 320 + 600 * f1 + 200 * f3 AS y2, CAST(round_even(20 * abs(f4), 0) AS INTEGER) AS class_id, 4 * abs(f5) AS score
  FROM (SELECT vec_id, r, {", ".join(f"CAST(embedding[CAST(r AS INTEGER) * {width} + {i + 1}] AS DOUBLE) AS f{i}" for i in range(6))} FROM embeddings, range({n}) t(r))"""


def label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, class_id, cx, cy, bw, bh): a box for each vector, as shares of an image of 640 by 480."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    from ..functions.geometry import normalised_centre

    x1, y1 = 320 + 400 * f(0), 240 + 300 * f(1)
    cx, cy, bw, bh = normalised_centre(x1, y1, x1 + 10 + 100 * F.abs(f(2)), y1 + 10 + 100 * F.abs(f(3)), F.lit(640.0), F.lit(480.0))
    return e.select("vec_id", F.col("label").cast("int").alias("class_id"), cx.alias("cx"), cy.alias("cy"), bw.alias("bw"), bh.alias("bh"))


BOXES_SQL = """corners AS (SELECT vec_id, CAST(label AS INTEGER) AS class_id, 320 + 400 * CAST(embedding[1] AS DOUBLE) AS x1, 240 + 300 * CAST(embedding[2] AS DOUBLE) AS y1,
  320 + 400 * CAST(embedding[1] AS DOUBLE) + 10 + 100 * abs(CAST(embedding[3] AS DOUBLE)) AS x2, 240 + 300 * CAST(embedding[2] AS DOUBLE) + 10 + 100 * abs(CAST(embedding[4] AS DOUBLE)) AS y2 FROM embeddings),
boxes AS (SELECT vec_id, class_id, (x1 + x2) / 2 / 640.0::DOUBLE AS cx, (y1 + y2) / 2 / 480.0::DOUBLE AS cy, (x2 - x1) / 640.0::DOUBLE AS bw, (y2 - y1) / 480.0::DOUBLE AS bh FROM corners)"""
