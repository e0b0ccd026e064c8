"""Queries over submissions and grades, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grading
from ..sources.paths import shared_folder
from ..streaming import submissions as stream
from . import fixtures as fx


def _scans(spark, sf_dir):
    return grading.parse_payloads(fx.messages(spark, sf_dir))


def payload_parse(spark, sf_dir):
    return _scans(spark, sf_dir).select("seq", "session_id", "student_id", "mcq_score", F.size("essay_scores").alias("n_essays"), "total_score", F.size("mistakes").alias("n_mistakes"))


def essay_totals(spark, sf_dir):
    return _scans(spark, sf_dir).select("seq", grading.essay_total(F.col("essay_scores")).alias("essay_total"))


def mistakes_roundtrip(spark, sf_dir):
    """Mistakes written as JSON, read back, a row each."""
    kind = "array<struct<q:int,student_ans:string,correct_ans:string>>"
    return grading.mistakes(_scans(spark, sf_dir).withColumn("mistakes", F.from_json(F.to_json("mistakes", {"ignoreNullFields": "false"}), kind)))


def registry_found(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("student_id"))
    return e.join(fx.registry(spark, sf_dir), "student_id", "left_semi").select("event_id", "student_id")


def registry_missing(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("student_id"))
    return grading.unknown_references(e, fx.registry(spark, sf_dir), "student_id", "student_id").select("event_id", "student_id")


def grading_responses(spark, sf_dir):
    return grading.response(grading.grade(_scans(spark, sf_dir), fx.registry(spark, sf_dir)))


def grades_first_wins(spark, sf_dir):
    everyone = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("student_id"))
    return grading.stored_grades(grading.grade(fx.order_scans(spark, sf_dir), everyone)).drop("timestamp", "mistakes_log")


def fk_audit(spark, sf_dir):
    """Grades whose student is not registered."""
    scans = fx.order_scans(spark, sf_dir).select("seq", "student_id")
    return grading.unknown_references(scans, fx.registry(spark, sf_dir), "student_id", "student_id").select("seq", "student_id")


def score_audit(spark, sf_dir):
    """By session: scans whose total is the sum of its parts, and the others; those without a score are neither."""
    audit = grading.score_audit(_scans(spark, sf_dir))
    return audit.groupBy("session_id").agg(F.count(F.when(F.col("consistent"), 1)).alias("n_consistent"), F.count(F.when(~F.col("consistent"), 1)).alias("n_other"))


def stream_first_wins(spark, sf_dir):
    """Events as a stream of messages: verdicts from keyed state, written to files until the input is used up."""
    path = f"{sf_dir}/events.parquet"
    source = stream.read_messages(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(path).schema)
    graded = stream.grade_stream(stream.read_payloads(fx.event_messages(source), "payload"), fx.registry(spark, sf_dir))
    base = shared_folder(spark)
    stream.run_to_files(graded, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(stream.GRADED).parquet(f"{base}/out").select("seq", "verdict", "previous_score")


QUERIES = {f.__name__: f for f in (payload_parse, essay_totals, mistakes_roundtrip, registry_found, registry_missing, grading_responses, grades_first_wins, fk_audit, score_audit, stream_first_wins)}
_VERDICT_SQL = f"""WITH {fx.SCANS_SQL}, {fx.REGISTRY_SQL},
joined AS (SELECT s.*, r.student_id IS NOT NULL AS found, s.mcq_score IS NOT NULL AS valid FROM scans s LEFT JOIN registry r USING (student_id)),
firsts AS (SELECT session_id, student_id, min(seq) AS first_seq, arg_min(total_score, seq) AS first_score FROM joined WHERE found AND valid GROUP BY ALL),
graded AS (SELECT j.*, CASE WHEN NOT found THEN 'id_not_found' WHEN first_seq < seq THEN 'duplicate_id' WHEN NOT valid THEN 'invalid_payload' ELSE 'success' END AS verdict, first_score
  FROM joined j LEFT JOIN firsts USING (session_id, student_id))"""
ORACLE = {
    "payload_parse": f"WITH {fx.SCANS_SQL} SELECT seq, session_id, student_id, mcq_score, CAST(n_essays AS INTEGER) AS n_essays, total_score, CAST(n_mistakes AS INTEGER) AS n_mistakes FROM scans",
    "essay_totals": f"WITH {fx.SCANS_SQL} SELECT seq, CAST(essay_total AS DOUBLE) AS essay_total FROM scans",
    "mistakes_roundtrip": f"WITH {fx.SCANS_SQL} SELECT seq, k AS q, 'A' AS student_ans, 'C' AS correct_ans FROM scans WHERE n_mistakes > 0 UNION ALL SELECT seq, CAST(7 AS INTEGER), NULL, 'D' FROM scans WHERE n_mistakes > 0",
    "registry_found": f"WITH {fx.REGISTRY_SQL} SELECT event_id, CAST(user_id AS VARCHAR) AS student_id FROM events WHERE CAST(user_id AS VARCHAR) IN (SELECT student_id FROM registry)",
    "registry_missing": f"WITH {fx.REGISTRY_SQL} SELECT event_id, CAST(user_id AS VARCHAR) AS student_id FROM events WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT student_id FROM registry)",
    "grading_responses": f"""{_VERDICT_SQL} SELECT seq, CASE WHEN verdict = 'success' THEN 'success' ELSE 'error' END AS status, CASE WHEN verdict <> 'success' THEN verdict END AS error_type,
CASE WHEN verdict = 'success' THEN total_score END AS total_score, CASE WHEN verdict = 'duplicate_id' THEN first_score END AS previous_score,
CASE verdict WHEN 'success' THEN '{grading.SAVED}' WHEN 'duplicate_id' THEN '{grading.DUPLICATE}' WHEN 'id_not_found' THEN replace('{grading.NOT_FOUND}', '%s', student_id) ELSE '{grading.INVALID}' END AS message FROM graded""",
    "grades_first_wins": """WITH firsts AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) = 1)
SELECT row_number() OVER (ORDER BY o_orderkey) AS scan_id, o_orderpriority AS session_id, CAST(o_custkey AS VARCHAR) AS student_id, CAST(floor(o_totalprice) AS DOUBLE) AS mcq_score,
CAST(5.5 AS DOUBLE) AS essay_total, CAST(floor(o_totalprice) + 5.5 AS DOUBLE) AS final_score FROM firsts""",
    "fk_audit": f"WITH {fx.REGISTRY_SQL} SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS student_id FROM orders WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT student_id FROM registry)",
    "score_audit": f"""WITH {fx.SCANS_SQL} SELECT session_id, count(*) FILTER (abs(mcq_score + essay_total - total_score) < 1e-9) AS n_consistent,
count(*) FILTER (abs(mcq_score + essay_total - total_score) >= 1e-9) AS n_other FROM scans GROUP BY session_id""",
    "stream_first_wins": f"{_VERDICT_SQL} SELECT seq, verdict, CASE WHEN verdict = 'duplicate_id' THEN first_score END AS previous_score FROM graded",
}
