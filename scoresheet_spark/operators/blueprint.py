"""Exam blueprints: points of essays, project configuration, and the packet that devices get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_ESSAY_POINTS

#: What a configuration says where it says nothing; fixed values.
DEFAULT_MODE = "Quiz Mode"


def essay_map(points: Column, enabled: Column) -> Column:
    """Q1, Q2, ... with their points; empty where essays are off or there are none."""
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points), F.lit(1))), lambda i: F.concat(F.lit("Q"), i.cast("string")))
    filled = F.transform(points, lambda p: F.coalesce(p, F.lit(DEFAULT_ESSAY_POINTS)))
    return F.when(enabled & (F.size(points) > 0), F.map_from_arrays(numbers, filled)).otherwise(F.create_map().cast("map<string,double>"))


def essay_list(points: Column) -> Column:
    """The map Q1..Qn as a list of {q_num, max}, by number."""
    return F.array_sort(F.transform(F.map_entries(points), lambda e: F.struct(F.substring(e["key"], 2, 9).cast("int").alias("q_num"), e["value"].alias("max"))))


def first_config(name: str, mode: Column | str, mcq_count: Column | int = 0) -> dict[str, Column]:
    """The fields of a new project's configuration."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return {"project_name": F.lit(name), "mode": lit(mode), "mcq_count": lit(mcq_count)}


def save_blueprint(config: DataFrame, fields: dict[str, Column], mode: str = "replace") -> DataFrame:
    """The configuration with new blueprint fields: `replace` forgets template and region, `merge` keeps them."""
    out = config.withColumns(fields)
    if mode == "merge":
        return out
    kinds = dict(config.dtypes)
    return out.withColumns({c: F.lit(None).cast(kinds[c]) for c in ("template_path", "roi_coordinates") if c in kinds})


def save_template(config: DataFrame, template_path: Column, roi: Column, rotation: Column | None = None) -> DataFrame:
    """The configuration with template and region, everything else as it was; `rotation` notes what the region refers to."""
    out = config.withColumns({"template_path": template_path, "roi_coordinates": roi})
    return out if rotation is None else out.withColumn("rotation", rotation)


def packet_rows(config: DataFrame, roster: DataFrame, group: str, project: str = "") -> DataFrame:
    """A row for each student of the group: configuration with defaults, and the student's id, name and presence. Nothing is gathered."""
    students = roster.filter(F.col("group_name") == group).select(F.col("student_id").alias("id"), F.col("student_name").alias("name"), F.col("is_present").alias("present"))
    named = _with_defaults(config, project)
    return students.crossJoin(F.broadcast(named)).select(*named.columns, F.lit(group).alias("group_name"), "id", "name", "present")


def _with_defaults(config: DataFrame, project: str) -> DataFrame:
    """One row at most: the configuration's fields, with defaults where it says nothing."""
    field = lambda c, kind, default: F.coalesce(F.col(c).cast(kind) if c in config.columns else F.lit(None).cast(kind), default)
    return config.limit(1).select(
        field("project_name", "string", F.lit(project)).alias("exam_name"),
        field("mode", "string", F.lit(DEFAULT_MODE)).alias("exam_mode"),
        field("mcq_count", "int", F.lit(0)).alias("mcq_count"),
        field("mcq_points", "double", F.lit(0.0)).alias("mcq_points"),
        field("has_essays", "boolean", F.lit(False)).alias("has_essays"),
        field("essay_points_map", "map<string,double>", F.create_map().cast("map<string,double>")).alias("essay_points_map"),
        field("template_path", "string", F.lit("")).alias("template_path"),
        (F.col("roi_coordinates") if "roi_coordinates" in config.columns else F.lit(None).cast("struct<x:int,y:int,w:int,h:int>")).alias("roi_coordinates"),
    )


def master_packet(config: DataFrame, roster: DataFrame, group: str, project: str = "") -> DataFrame:
    """One row: configuration with defaults, and the group's roster; no row where the group has no student.

    It is the document that one device loads, so a group has to fit a row; `packet_rows` has no such bound.
    """
    member = F.struct(F.col("student_id").alias("id"), F.col("student_name").alias("name"), F.col("is_present").alias("present"))
    listed = roster.filter(F.col("group_name") == group).agg(F.array_sort(F.collect_list(member)).alias("roster")).filter(F.size("roster") > 0)
    named = _with_defaults(config, project)
    return listed.crossJoin(F.broadcast(named)).select(*named.columns, F.lit(group).alias("group_name"), "roster")


def packet_json(packet: DataFrame) -> DataFrame:
    """The packet as a line of JSON, with empty fields written out."""
    return packet.select(F.to_json(F.struct(*packet.columns), {"ignoreNullFields": "false"}).alias("value"))
