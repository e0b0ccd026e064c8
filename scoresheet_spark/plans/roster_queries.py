"""Queries over rosters, blueprints and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blueprint, roster
from . import fixtures as fx

GROUP = "BUILDING"
_CLEAN_SQL = """SELECT regexp_replace(regexp_replace(raw_id, '^\\s+', ''), '\\s+$', '') AS student_id, c_name AS student_name,
  CAST(CASE WHEN c_nationkey < 13 THEN 1 ELSE 0 END AS INTEGER) AS is_present, 'import' AS group_name
FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN chr(9) || c_custkey || ' ' END AS raw_id FROM customer) WHERE raw_id IS NOT NULL"""


def roster_clean(spark, sf_dir):
    return roster.clean_roster(fx.sheet(spark, sf_dir), "import")


def roster_upsert_last_wins(spark, sf_dir):
    return roster.upsert(fx.roster(spark, sf_dir), fx.imports(spark, sf_dir))


def group_counts(spark, sf_dir):
    return roster.group_counts(fx.roster(spark, sf_dir))


def group_size(spark, sf_dir):
    return roster.group_size(fx.roster(spark, sf_dir), GROUP)


def group_card_grid(spark, sf_dir):
    return roster.card_grid(group_counts(spark, sf_dir))


def attendance_export(spark, sf_dir):
    return roster.export(fx.roster(spark, sf_dir), GROUP)


def import_metrics(spark, sf_dir):
    return roster.import_metrics(fx.imports(spark, sf_dir))


def blueprint_map(spark, sf_dir):
    """A blueprint for each part: as many essays as its size says, up to 20, off for one type; its map, a row for each entry."""
    p = fx.table(spark, sf_dir, "part")
    points = F.transform(F.sequence(F.lit(1), F.least("p_size", F.lit(20))), lambda i: F.when(i == 2, F.lit(None)).otherwise(i / 2).cast("double"))
    rows = p.select("p_partkey", blueprint.essay_map(points, F.col("p_type") != "ECONOMY").alias("m"))
    return rows.select("p_partkey", F.explode("m").alias("question", "points"))


def master_packet(spark, sf_dir):
    """The packet of one group, a row for each student on it."""
    config = spark.range(1).select(F.lit("Midterm").alias("project_name"), F.lit(40).alias("mcq_count"), F.lit(0.5).alias("mcq_points"), F.lit(True).alias("has_essays"), F.create_map(F.lit("Q1"), F.lit(2.0)).alias("essay_points_map"))
    packet = blueprint.packet_rows(config, fx.roster(spark, sf_dir), GROUP)
    return packet.select("exam_name", "exam_mode", "mcq_count", "mcq_points", "has_essays", F.col("essay_points_map")["Q1"].alias("q1_points"), "template_path", "group_name", "id", "name", "present")


QUERIES = {f.__name__: f for f in (roster_clean, roster_upsert_last_wins, group_counts, group_size, group_card_grid, attendance_export, import_metrics, blueprint_map, master_packet)}
_COUNTS_SQL = "counts AS (SELECT group_name, count(*) AS n_students FROM roster WHERE coalesce(group_name, '') <> '' GROUP BY group_name)"
ORACLE = {
    "roster_clean": _CLEAN_SQL,
    "roster_upsert_last_wins": f"""WITH {fx.ROSTER_SQL}, {fx.IMPORTS_SQL},
both_ AS (SELECT *, -1 AS seq FROM roster UNION ALL BY NAME SELECT * FROM imports)
SELECT student_id, student_name, is_present, group_name FROM both_ QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY seq DESC) = 1""",
    "group_counts": f"WITH {fx.ROSTER_SQL}, {_COUNTS_SQL} SELECT * FROM counts",
    "group_size": f"WITH {fx.ROSTER_SQL} SELECT count(*) AS n_students FROM roster WHERE group_name = '{GROUP}'",
    "group_card_grid": f"""WITH {fx.ROSTER_SQL}, {_COUNTS_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY group_name) - 1 AS pos FROM counts)
SELECT group_name, n_students, CAST(pos // 3 AS INTEGER) AS grid_row, CAST(pos % 3 AS INTEGER) AS grid_col FROM placed""",
    "attendance_export": f"""WITH {fx.ROSTER_SQL} SELECT student_id AS "ID", student_name AS "Name", CASE WHEN is_present = 1 THEN 'Present' ELSE 'Absent' END AS "Status" FROM roster WHERE group_name = '{GROUP}'""",
    "import_metrics": f"""WITH {fx.IMPORTS_SQL}, last_ AS (SELECT * FROM imports QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY seq DESC) = 1)
SELECT group_name, count(*) AS n_processed, (SELECT count(*) FROM last_ WHERE last_.group_name = imports.group_name) AS n_stored FROM imports GROUP BY group_name""",
    "blueprint_map": """SELECT p_partkey, 'Q' || i AS question, CAST(CASE WHEN i = 2 THEN 2.0 ELSE i / 2 END AS DOUBLE) AS points
FROM part, range(1, 21) t(i) WHERE i <= p_size AND p_type <> 'ECONOMY'""",
    "master_packet": f"""WITH {fx.ROSTER_SQL} SELECT 'Midterm' AS exam_name, 'Quiz Mode' AS exam_mode, CAST(40 AS INTEGER) AS mcq_count, CAST(0.5 AS DOUBLE) AS mcq_points, true AS has_essays,
CAST(2.0 AS DOUBLE) AS q1_points, '' AS template_path, group_name, student_id AS id, student_name AS name, is_present AS present FROM roster WHERE group_name = '{GROUP}'""",
}
