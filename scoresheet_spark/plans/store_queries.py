"""Queries over what the library stores and sends: grades, configuration, spreadsheets, packets."""

from __future__ import annotations

import socket

from pyspark.sql import functions as F

from ..operators import blueprint, grading
from ..sources import config as configs
from ..sources import schemas, workbook
from ..sources.packets import PacketServer
from ..sources.paths import shared_folder
from ..sources.versions import VersionedTable
from ..streaming import submissions as stream
from . import fixtures as fx
from .grading_queries import _VERDICT_SQL
from .roster_queries import GROUP


def client_responses(spark, sf_dir):
    """Answers to scans, each with the client that it goes to."""
    rows = fx.messages(spark, sf_dir).withColumn("client_id", F.concat(F.lit("client-"), (F.col("seq") % 7).cast("string")))
    return grading.response(grading.grade(grading.parse_payloads(rows), fx.registry(spark, sf_dir))).select("seq", "client_id", "status")


def _stored(spark, sf_dir, base, times):
    """A store that `times` streams, each with a checkpoint of its own, have filled from all messages."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(provider)
    spark.conf.set(provider, stream.ROCKS)
    try:
        for i in range(times):
            source = stream.read_messages(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)
            graded = stream.grade_stream_from(stream.read_payloads(fx.event_messages(source), "payload"), fx.registry(spark, sf_dir), stream.read_store(spark, f"{base}/grades"))
            stream.run_to_store(graded, f"{base}/grades", f"{base}/state-{i}").awaitTermination()
    finally:
        spark.conf.set(provider, held)
    return stream.read_store(spark, f"{base}/grades")


def stored_stream(spark, sf_dir):
    """Grades that streams have written to the store whole, with dense scan ids; a second stream with a new checkpoint finds all of them there and adds none."""
    return _stored(spark, sf_dir, shared_folder(spark), 2).select(*schemas.schema("grades").names[:-1], F.col("timestamp").isNotNull().alias("timed"))


def _imported(spark, sf_dir):
    """A roster's table in versions: the roster as it was, then imports up to 1994, then later ones, which are committed twice."""
    rows = fx.roster(spark, sf_dir).withColumn("seq", F.lit(0))
    table = VersionedTable.create(spark, f"{shared_folder(spark)}/roster", rows.drop("seq").schema, ["student_id"], 16)
    table.put(rows, "seq", "roster")
    dates = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.year("o_orderdate") > 1994).alias("late"))
    imports = fx.imports(spark, sf_dir).join(dates, "seq")
    for name in ("early", "late", "late"):
        table.put(imports.filter(F.col("late") == (name == "late")), "seq", name)
    return table


def import_commits(spark, sf_dir):
    """The roster after two imports, each one commit; one that is committed again changes nothing."""
    return _imported(spark, sf_dir).read()


def import_history(spark, sf_dir):
    """Students in each version of the roster."""
    return _imported(spark, sf_dir).history().select("number", "n_rows")


def _two_streams(spark, sf_dir):
    """Grades of one table in versions to which two streams have added, each from nothing and over all messages."""
    base, kinds = shared_folder(spark), schemas.schema("grades")
    table = VersionedTable.create(spark, f"{base}/grades", kinds, ["session_id", "student_id"], 16)
    provider = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(provider)
    spark.conf.set(provider, stream.ROCKS)
    try:
        for i in range(2):
            source = stream.read_messages(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)
            graded = stream.grade_stream_from(stream.read_payloads(fx.event_messages(source), "payload"), fx.registry(spark, sf_dir), schemas.empty(spark, "grades"))
            stream.run_to_versions(graded, table, f"{base}/state-{i}").awaitTermination()
    finally:
        spark.conf.set(provider, held)
    return table.read()


def versioned_grades(spark, sf_dir):
    """Grades of a table in versions: two streams that know nothing of each other leave one grade a pair, with dense scan ids."""
    return _two_streams(spark, sf_dir).select(*schemas.schema("grades").names[:-1], F.col("timestamp").isNotNull().alias("timed"))


def line_stream(spark, sf_dir):
    """Messages as lines of text files, read as a stream: answers' verdicts."""
    base = shared_folder(spark)
    lines = fx.messages(spark, sf_dir).select(F.to_json(F.struct("seq", F.concat(F.lit("client-"), F.col("seq") % 3).alias("client_id"), "payload")).alias("value"))
    lines.write.text(f"{base}/lines")
    read = stream.read_payloads(stream.read_lines(spark, f"{base}/lines"), "payload")
    stream.run_to_files(read.select("seq", "client_id", "session_id", "total_score"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("seq bigint, client_id string, session_id string, total_score double").parquet(f"{base}/out")


def stored_defaults(spark, sf_dir):
    """What a grade is stored with where the message says nothing: log of mistakes and time of arrival."""
    kept = grading.stored_grades(grading.grade(grading.parse_payloads(fx.messages(spark, sf_dir)), fx.registry(spark, sf_dir)))
    return kept.select("scan_id", "essay_total", (F.col("mistakes_log") == "[]").alias("no_mistakes"), F.col("timestamp").isNotNull().alias("timed"))


def config_merge(spark, sf_dir):
    """A configuration written, read, given a template, written and read again."""
    path = f"{shared_folder(spark)}/config.json"
    first = spark.range(1).select(*(c.alias(n) for n, c in blueprint.first_config("Midterm", "Exam Mode", 30).items()))
    configs.write_config(first, path)
    region = F.struct(*(F.lit(v).alias(n) for n, v in (("x", 1), ("y", 2), ("w", 30), ("h", 40))))
    configs.write_config(blueprint.save_template(configs.read_config(spark, path), F.lit("t.jpg"), region), path)
    return configs.read_config(spark, path).select("project_name", "mode", "mcq_count", "template_path", F.col("roi_coordinates.w").alias("w"), F.col("roi_coordinates.h").alias("h"), "has_essays")


def workbook_round_trip(spark, sf_dir):
    """A roster written as spreadsheets by the executors, as many as it fills, and read back as text."""
    folder = f"{shared_folder(spark)}/roster"
    rows = fx.roster(spark, sf_dir).select("student_id", "student_name", F.col("group_name").alias("Group"))
    workbook.write_workbooks(rows.repartition("student_id"), folder)
    return workbook.read_workbook(spark, folder)


def sql_source(spark, sf_dir):
    """A SQL query over the store with a bound value."""
    schemas.register({"roster": fx.roster(spark, sf_dir)})
    return schemas.query(spark, "SELECT student_id, student_name FROM roster WHERE group_name = :group AND is_present = 1", group=GROUP)


def stored_tables(spark, sf_dir):
    """Columns of the tables that a new store has."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name in ("registry", "sessions", "grades", "roster") for i, f in enumerate(schemas.empty(spark, name).schema)]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, kind string").filter("table_name IN ('registry', 'roster')")


def packet_lines(spark, sf_dir):
    """What a device gets that connects: the packet as a line of JSON; a group without students has none."""
    config = spark.range(1).select(F.lit("Midterm").alias("project_name"), F.lit(40).alias("mcq_count"))
    server = PacketServer(blueprint.master_packet(config, fx.roster(spark, sf_dir), GROUP)).start()
    try:
        with socket.create_connection(server.address, timeout=60) as device, device.makefile() as said:
            line = said.readline()
    finally:
        server.stop()
    none = blueprint.master_packet(config, fx.roster(spark, sf_dir), "nobody").count()
    kind = "exam_name string, exam_mode string, mcq_count int, template_path string, group_name string, roster array<struct<id:string,name:string,present:int>>"
    p = spark.createDataFrame([(line,)], "value string").select(F.from_json("value", kind).alias("p")).select("p.*")
    return p.select("exam_name", "exam_mode", "mcq_count", "template_path", "group_name", F.size("roster").cast("bigint").alias("n_students"), F.lit(none).cast("bigint").alias("n_empty"))


QUERIES = {f.__name__: f for f in (client_responses, stored_stream, import_commits, import_history, versioned_grades, line_stream, stored_defaults, config_merge, workbook_round_trip, sql_source, stored_tables, packet_lines)}
_DATED_SQL = f"""{fx.ROSTER_SQL}, {fx.IMPORTS_SQL}, given AS (SELECT student_id, student_name, is_present, group_name, 1 AS number, 0 AS seq FROM roster
UNION ALL SELECT student_id, student_name, is_present, group_name, CASE WHEN year(o_orderdate) > 1994 THEN 3 ELSE 2 END, seq FROM imports JOIN orders ON o_orderkey = seq)"""
ORACLE = {
    "import_commits": f"WITH {_DATED_SQL} SELECT student_id, student_name, is_present, group_name FROM given QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY number DESC, seq DESC) = 1",
    "import_history": f"WITH {_DATED_SQL} SELECT CAST(v.number AS BIGINT) AS number, count(DISTINCT student_id) AS n_rows FROM range(0, 4) v(number) LEFT JOIN given ON given.number <= v.number GROUP BY v.number",
    "client_responses": f"{_VERDICT_SQL} SELECT seq, 'client-' || seq % 7 AS client_id, CASE WHEN verdict = 'success' THEN 'success' ELSE 'error' END AS status FROM graded",
    "stored_stream": f"""{_VERDICT_SQL} SELECT row_number() OVER (ORDER BY seq) AS scan_id, session_id, student_id, CAST(mcq_score AS DOUBLE) AS mcq_score, CAST(essay_total AS DOUBLE) AS essay_total, total_score AS final_score,
CASE WHEN n_mistakes = 0 THEN '[]' ELSE '[{{"q":' || k || ',"student_ans":"A","correct_ans":"C"}},{{"q":7,"correct_ans":"D"}}]' END AS mistakes_log, true AS timed FROM graded WHERE verdict = 'success'""",
    "line_stream": f"WITH {fx.SCANS_SQL} SELECT seq, 'client-' || seq % 3 AS client_id, session_id, total_score FROM scans",
    "stored_defaults": f"{_VERDICT_SQL} SELECT row_number() OVER (ORDER BY seq) AS scan_id, CAST(essay_total AS DOUBLE) AS essay_total, n_mistakes = 0 AS no_mistakes, true AS timed FROM graded WHERE verdict = 'success'",
    "config_merge": "SELECT 'Midterm' AS project_name, 'Exam Mode' AS mode, CAST(30 AS INTEGER) AS mcq_count, 't.jpg' AS template_path, CAST(30 AS INTEGER) AS w, CAST(40 AS INTEGER) AS h, CAST(NULL AS BOOLEAN) AS has_essays",
    "workbook_round_trip": f"""WITH {fx.ROSTER_SQL} SELECT student_id, student_name, group_name AS "Group" FROM roster""",
    "sql_source": f"WITH {fx.ROSTER_SQL} SELECT student_id, student_name FROM roster WHERE group_name = '{GROUP}' AND is_present = 1",
    "stored_tables": """SELECT table_name, CAST(place AS INTEGER) AS place, column_name, kind FROM (VALUES ('registry', 0, 'student_id', 'string'), ('registry', 1, 'student_name', 'string'),
('roster', 0, 'student_id', 'string'), ('roster', 1, 'student_name', 'string'), ('roster', 2, 'is_present', 'int'), ('roster', 3, 'group_name', 'string')) t(table_name, place, column_name, kind)""",
    "packet_lines": f"""WITH {fx.ROSTER_SQL} SELECT 'Midterm' AS exam_name, 'Quiz Mode' AS exam_mode, CAST(40 AS INTEGER) AS mcq_count, '' AS template_path, '{GROUP}' AS group_name,
count(*) AS n_students, CAST(0 AS BIGINT) AS n_empty FROM roster WHERE group_name = '{GROUP}'""",
}
ORACLE["versioned_grades"] = ORACLE["stored_stream"]
