"""Rosters: clean imports, upserts, head-counts, placement on a grid, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import not_blank, strip


def normalise_header(df: DataFrame) -> DataFrame:
    """Column names in lower case and without outer white space."""
    return df.toDF(*(c.lower().strip() for c in df.columns))


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def present(flag: Column) -> Column:
    """1 where the attendance cell is exactly 1, else 0, null included."""
    return F.when(strip(flag.cast("string")) == "1", 1).otherwise(0)


def clean_roster(df: DataFrame, group: str | Column, legacy_numeric_ids: bool = False, reject_blank_names: bool = True) -> DataFrame:
    """(student_id, student_name, is_present, group_name) of an imported sheet; rows without an id are dropped.

    `legacy_numeric_ids` writes whole numbers as spreadsheets do that hold blank ids (101 as 101.0).
    """
    df = require(normalise_header(df), "id", "name")
    student = strip(F.col("id").cast("string"))
    if legacy_numeric_ids:
        student = F.when(student.rlike(r"^\d+$"), F.concat(student, F.lit(".0"))).otherwise(student)
    rows = df.filter(F.col("id").isNotNull())
    if reject_blank_names:
        rows = rows.filter(F.coalesce(not_blank(F.col("name").cast("string")), F.lit(False)))
    kept = [c for c in ("seq",) if c in df.columns]
    return rows.select(
        student.alias("student_id"),
        strip(F.coalesce(F.col("name").cast("string"), F.lit("nan"))).alias("student_name"),
        (present(F.col("s6")) if "s6" in df.columns else F.lit(1)).alias("is_present"),
        (group if isinstance(group, Column) else F.lit(group)).alias("group_name"),
        *kept,
    )


def last_wins(rows: DataFrame, key: str = "student_id", seq: str = "seq") -> DataFrame:
    """For each key the row that came last. Summed before the shuffle, so a key with many rows costs no more than another."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(seq, *(c for c in rest if c != seq))).alias("_last"))
    return best.select(key, *(F.col(f"_last.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """The store after an import: an incoming row replaces the student's row, whatever its group."""
    old = existing.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(0).cast("bigint"))
    new = incoming.withColumn("_new", F.lit(1)).withColumn("_seq", F.col(seq).cast("bigint"))
    shared = [*existing.columns, "_new", "_seq"]
    both = old.select(*shared).unionByName(new.select(*shared)).withColumn("_order", F.struct("_new", "_seq"))
    return last_wins(both.drop("_new", "_seq"), seq="_order").drop("_order")


def group_counts(roster: DataFrame) -> DataFrame:
    """Students of each group; rows without a group are left out after counting."""
    counts = roster.groupBy("group_name").agg(F.count(F.lit(1)).alias("n_students"))
    return counts.filter(F.coalesce("group_name", F.lit("")) != "")


def group_size(roster: DataFrame, group: str) -> DataFrame:
    return roster.filter(F.col("group_name") == group).agg(F.count(F.lit(1)).alias("n_students"))


def card_grid(groups: DataFrame, per_row: int = 3, order: str = "group_name") -> DataFrame:
    """Row and column of each group's card. Groups are few: a row each."""
    at = F.row_number().over(Window.orderBy(order)) - 1
    return groups.withColumn("_at", at).withColumn("grid_row", F.floor(F.col("_at") / per_row).cast("int")).withColumn("grid_col", (F.col("_at") % per_row).cast("int")).drop("_at")


def essay_grid(position: Column) -> tuple[Column, Column]:
    """Row and column of an essay's input field: three pairs of label and field in a row."""
    return F.floor(position / 3).cast("int"), ((position % 3) * 2).cast("int")


def export(roster: DataFrame, group: str) -> DataFrame:
    """The sheet of one group: ID, Name, Status."""
    status = F.when(F.col("is_present") == 1, "Present").otherwise("Absent")
    return roster.filter(F.col("group_name") == group).select(F.col("student_id").alias("ID"), F.col("student_name").alias("Name"), status.alias("Status"))


def import_metrics(rows: DataFrame) -> DataFrame:
    """By group: rows imported, and students in the group once later rows have replaced earlier ones."""
    processed = rows.groupBy("group_name").agg(F.count(F.lit(1)).alias("n_processed"))
    stored = last_wins(rows).groupBy("group_name").agg(F.count(F.lit(1)).alias("n_stored"))
    return processed.join(stored, "group_name", "left").select("group_name", "n_processed", F.coalesce("n_stored", F.lit(0)).alias("n_stored"))
