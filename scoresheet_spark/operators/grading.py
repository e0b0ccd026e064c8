"""Grading of scanned sheets: the first scan of a student in a session counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import SCHEMAS
from .skew import join_by_key

#: What the answers to a scan say; fixed values.
SAVED = "Grade saved successfully."
DUPLICATE = "Duplicate Scan! This paper has already been graded."
NOT_FOUND = "ID %s not found in registry. Please verify manually."
INVALID = "Invalid payload."


def parse_payloads(df: DataFrame, json: str = "payload", seq: str = "seq") -> DataFrame:
    """Submissions out of JSON messages; lists that are missing are empty, unreadable messages are null throughout. `client_id`, where there, is kept."""
    client = [c for c in ("client_id",) if c in df.columns]
    rows = df.select(F.col(seq).cast("bigint").alias("seq"), *client, F.from_json(F.col(json), SCHEMAS["submission"]).alias("p")).select("seq", *client, "p.*")
    return rows.withColumn("essay_scores", F.coalesce("essay_scores", F.array().cast("array<double>"))).withColumn("mistakes", F.coalesce("mistakes", F.array().cast("array<struct<q:int,student_ans:string,correct_ans:string>>")))


def essay_total(scores: Column) -> Column:
    """Sum of a list of points; 0 for an empty or missing list."""
    return F.aggregate(F.coalesce(scores, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def complete(df: DataFrame) -> Column:
    """Whether a submission holds all that a grade must have."""
    return F.col("session_id").isNotNull() & F.col("student_id").isNotNull() & F.col("mcq_score").isNotNull() & F.col("total_score").isNotNull()


def verdict(found: Column, valid: Column, first_seq: Column, seq: Column) -> Column:
    """success, id_not_found, duplicate_id or invalid_payload, in this order of precedence: registry, earlier grade, payload."""
    return F.when(~found, "id_not_found").when(first_seq < seq, "duplicate_id").when(~valid, "invalid_payload").otherwise("success")


def response(df: DataFrame) -> DataFrame:
    """Answers to scans from verdict, total_score, student_id and previous_score; `client_id`, where there, says whom each is for."""
    v = F.col("verdict")
    return df.select(
        "seq",
        *(c for c in ("client_id",) if c in df.columns),
        F.when(v == "success", "success").otherwise("error").alias("status"),
        F.when(v != "success", v).alias("error_type"),
        F.when(v == "success", F.col("total_score")).alias("total_score"),
        F.when(v == "duplicate_id", F.col("previous_score")).alias("previous_score"),
        F.when(v == "success", SAVED).when(v == "duplicate_id", DUPLICATE).when(v == "id_not_found", F.format_string(NOT_FOUND, F.coalesce("student_id", F.lit("None")))).otherwise(INVALID).alias("message"),
    )


def grade(submissions: DataFrame, registry: DataFrame) -> DataFrame:
    """Submissions with verdict and previous_score.

    The first complete scan of each registered (session, student) is found by a sum before the shuffle and
    joined back; scans of a pair that is scanned very often are dealt to many tasks, which no window allows.
    """
    known = registry.select(F.col("student_id")).distinct().withColumn("_found", F.lit(True))
    counts = submissions.groupBy("student_id").agg(F.count(F.lit(1)).alias("_n"))
    looked_up = join_by_key(submissions, counts.join(known, "student_id", "left"), ["student_id"], "_n", F.col("seq"))
    rows = looked_up.withColumn("_found", F.coalesce("_found", F.lit(False))).withColumn("_valid", complete(submissions))
    keys = ["session_id", "student_id"]
    counted = F.when(F.col("_found") & F.col("_valid"), F.col("seq"))
    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(counted).alias("_first"), F.min_by("total_score", counted).alias("_score"))
    joined = join_by_key(rows, first, keys, "_n", F.col("seq"))
    return joined.withColumn("verdict", verdict(F.col("_found"), F.col("_valid"), F.col("_first"), F.col("seq"))).withColumn("previous_score", F.col("_score")).drop("_found", "_valid", "_first", "_score")


def _before(counts: DataFrame, levels: int, fan: int) -> DataFrame:
    """(_bucket, _before): the rows of all earlier buckets, summed among `fan` neighbours, then among groups of neighbours."""
    earlier = lambda among: F.coalesce(F.sum("_n").over(among.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not levels:
        return counts.select("_bucket", earlier(Window).alias("_before"))
    up = counts.withColumn("_up", F.floor(F.col("_bucket") / fan))
    groups = _before(up.groupBy(F.col("_up").alias("_bucket")).agg(F.sum("_n").alias("_n")), levels - 1, fan)
    within = up.select("_bucket", "_up", earlier(Window.partitionBy("_up")).alias("_within"))
    return within.join(groups.withColumnRenamed("_bucket", "_up"), "_up").select("_bucket", (F.col("_before") + F.col("_within")).alias("_before"))


def numbered(df: DataFrame, order: str, name: str, width: int = 1_000_000, fan: int = 1_000_000) -> DataFrame:
    """`name`: 1, 2, ... without gaps in the order of a unique integer column.

    Rows are numbered within buckets of `width` values, buckets by their counts within groups of `fan` buckets, and
    these within groups of theirs. So no task has more than `width` rows or `fan` counts, sparse values (hashes, time
    stamps) included, down to the few groups of groups that 64 bits leave.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width))
    first = _before(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), 2, fan)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(order)))
    return ranked.join(first, "_bucket").withColumn(name, (F.col("_before") + F.col("_rank")).cast("bigint")).drop("_bucket", "_before", "_rank")


def stored_grades(graded: DataFrame) -> DataFrame:
    """The grades that are kept, with dense scan ids in order of arrival."""
    kept = numbered(graded.filter("verdict = 'success'"), "seq", "scan_id")
    return kept.select("scan_id", "session_id", "student_id", "mcq_score", essay_total(F.col("essay_scores")).alias("essay_total"), F.col("total_score").alias("final_score"), F.to_json("mistakes").alias("mistakes_log"), F.current_timestamp().alias("timestamp"))


def unknown_references(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has: what a foreign key would refuse."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def score_audit(submissions: DataFrame) -> DataFrame:
    """Whether the total that was sent is the sum of its parts (an addition: grading itself trusts the total)."""
    return submissions.withColumn("consistent", F.abs(F.col("mcq_score") + essay_total(F.col("essay_scores")) - F.col("total_score")) < 1e-9)


def mistakes(submissions: DataFrame) -> DataFrame:
    """A row for each mistake."""
    return submissions.select("seq", F.explode("mistakes").alias("m")).select("seq", "m.q", "m.student_ans", "m.correct_ans")
