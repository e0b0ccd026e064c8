"""Grading as a stream: submissions arrive as JSON messages, and each gets its answer.

The first complete scan of a registered (session, student) is remembered without end, as the contract wants:
state grows with distinct pairs, which share the keys of the state in groups. `watermark` bounds it where that is acceptable, as a deviation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.grading import complete, essay_total, numbered, parse_payloads
from ..sources.config import exists
from ..sources.schemas import SCHEMAS, schema
from ..sources.versions import VersionedTable

#: Answers of a group of pairs that leave a task at once.
PART = 10_000
#: Groups that pairs are dealt to by a hash. One is a key of the state, as Python is called for each key: a call for each pair takes far longer than its
#: messages. A micro-batch writes the scores of each group that it adds to again. A checkpoint holds on to the number.
GROUPS = 2_048
GRADED = "seq bigint, session_id string, student_id string, total_score double, verdict string, previous_score double"
#: What a grade keeps of its message beside the total.
DETAILS = "mcq_score double, essay_total double, mistakes_log string"
STORED = SCHEMAS["grades"]


def read_messages(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def read_payloads(messages: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """Submissions out of a stream of JSON messages that carry a number of arrival."""
    return parse_payloads(messages, value, seq)


def read_lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """New lines of text files in a folder as a stream: (seq, client_id, payload), a JSON object each."""
    lines = spark.readStream.options(**options).text(folder)
    return lines.select(F.from_json("value", "seq bigint, client_id string, payload string").alias("m")).select("m.*")


def with_registry(submissions: DataFrame, registry: DataFrame) -> DataFrame:
    """Each message looks the registry up as it is processed."""
    known = registry.select("student_id").distinct().withColumn("found", F.lit(True))
    joined = submissions.join(known, "student_id", "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("valid", complete(submissions))


def _in_groups(rows: DataFrame) -> DataFrame:
    """Rows with `pairs`, the group that their pair falls into."""
    return rows.withColumn("pairs", F.pmod(F.xxhash64("session_id", "student_id"), F.lit(GROUPS)).cast("int"))


def _packed(known: dict[tuple[str, str], float]) -> bytes:
    """Pairs with the scores that count, as what a state holds."""
    sessions, students = ([pair[i] for pair in known] for i in range(2))
    batch = pa.RecordBatch.from_arrays([pa.array(sessions, pa.string()), pa.array(students, pa.string()), pa.array(known.values(), pa.float64())], names=["session_id", "student_id", "score"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> dict[tuple[str, str], float]:
    sessions, students, scores = (c.to_pylist() for c in pa.ipc.open_stream(held).read_all().columns)
    return dict(zip(zip(sessions, students, strict=True), scores, strict=True))


def _judged(batches: Iterator[pd.DataFrame], known: dict[tuple[str, str], float], details: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    """Verdicts of the messages of a group of pairs, in order of arrival; the scores that count are added to `known` at once.

    Of a micro-batch only the group's numbers are held (22 bytes a message), its pairs, and `details` of a message or so for each pair; answers
    leave in parts of PART rows.
    """
    codes: dict[tuple, int] = {}
    held, picked = [], []
    for b in batches:
        seq, found, valid = b["seq"].to_numpy(), b["found"].to_numpy(bool), b["valid"].to_numpy(bool)
        (session, sessions), (student, students) = (pd.factorize(b[c], use_na_sentinel=False) for c in ("session_id", "student_id"))
        sessions, students = ([None if pd.isna(x) else x for x in names] for names in (sessions, students))
        both, at = np.unique(session * np.int64(max(1, len(students))) + student, return_inverse=True)
        code = np.array([codes.setdefault((sessions[x // len(students)], students[x % len(students)]), len(codes)) for x in both.tolist()], np.int32)[at]
        held.append((code, seq, b["total_score"].to_numpy(float), found, valid))
        if details:
            counts = np.flatnonzero(found & valid)
            counts = counts[np.argsort(seq[counts], kind="stable")]
            first = counts[np.unique(code[counts], return_index=True)[1]]
            picked.append(b[["seq", *details]].iloc[first].assign(code=code[first]))
    code, seq, total, found, valid = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(seq, kind="stable")
    code, seq, total, found, valid = code[order], seq[order], total[order], found[order], valid[order]
    pairs = list(codes)
    earlier = np.array([p in known for p in pairs], bool)
    score = np.array([known.get(p, np.nan) for p in pairs], float)
    # the place of each pair's message that counts: before all where it has a grade, behind all where none counts
    first = np.where(earlier, -1, len(seq))
    counts = np.flatnonzero(found & valid)
    having, at = np.unique(code[counts], return_index=True)
    new = ~earlier[having]
    having, at = having[new], counts[at[new]]
    first[having], score[having] = at, total[at]
    known.update((pairs[c], x) for c, x in zip(having.tolist(), score[having].tolist(), strict=True))
    place = np.arange(len(seq))
    verdicts = np.select([~found, place > first[code], place == first[code]], ["id_not_found", "duplicate_id", "success"], "invalid_payload").astype(object)
    previous = np.where(verdicts == "duplicate_id", score[code], np.nan)
    session, student = (np.array([p[i] for p in pairs], object) for i in range(2))
    said = pd.concat(picked).sort_values("seq", kind="stable").drop_duplicates("code").set_index("code") if details else None

    def parts() -> Iterator[pd.DataFrame]:
        for i in range(0, len(seq), PART):
            part = slice(i, i + PART)
            out = pd.DataFrame({"seq": seq[part], "session_id": session[code[part]], "student_id": student[code[part]], "total_score": total[part], "verdict": verdicts[part], "previous_score": previous[part]})
            if details:
                mine = said.reindex(code[part])
                for c in details:
                    out[c] = mine[c].where((verdicts[part] == "success"), None).to_numpy()
            yield out

    return parts()


def _first_wins(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Verdicts of a group's messages; the state is the scores that count of its pairs."""
    known = _unpacked(bytes(state.get[0])) if state.exists else {}
    before = len(known)
    parts = _judged(batches, known)
    if len(known) > before:
        state.update((_packed(known),))
    yield from parts


def grade_stream(submissions: DataFrame, registry: DataFrame) -> DataFrame:
    """Verdict of every message, within its micro-batch in order of arrival."""
    rows = with_registry(submissions, registry).select("seq", "session_id", "student_id", "total_score", "found", "valid")
    return _in_groups(rows).groupBy("pairs").applyInPandasWithState(_first_wins, GRADED, "scores binary", "append", GroupStateTimeout.NoTimeout)


class _FirstScan(StatefulProcessor):
    """Verdicts of a group's messages in a keyed value that starts from the stored grades of its pairs; details stay with the messages that count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getValueState("scores", "scores binary")

    def _known(self) -> dict[tuple[str, str], float]:
        return _unpacked(bytes(self.scores.get()[0])) if self.scores.exists() else {}

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timer: Any) -> None:
        stored = zip(initial["session_id"], initial["student_id"], initial["final_score"].astype(float), strict=True)
        self.scores.update((_packed({**self._known(), **{(s, t): x for s, t, x in stored}}),))  # a large group comes in parts

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        known = self._known()
        before = len(known)
        parts = _judged(rows, known, tuple(DETAIL_NAMES))
        if len(known) > before:
            self.scores.update((_packed(known),))
        yield from parts

    def close(self) -> None:
        pass


GRADED_NAMES, DETAIL_NAMES = ([f.split()[0] for f in x.split(", ")] for x in (GRADED, DETAILS))
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def grade_stream_from(submissions: DataFrame, registry: DataFrame, stored: DataFrame) -> DataFrame:
    """As `grade_stream`, on top of the grades that are `stored`: a stream with a new checkpoint knows who has been graded.

    Rows carry the details of a grade where the verdict is success. State is a keyed value in RocksDB, which the session must name as its
    provider of state (`spark.sql.streaming.stateStore.providerClass`); the stored grades are dealt to it once, as the stream begins.
    """
    spark = submissions.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name) != ROCKS:
        raise ValueError(f"set {name} to {ROCKS}")
    logged = submissions.withColumn("essay_total", essay_total(F.col("essay_scores"))).withColumn("mistakes_log", F.to_json("mistakes"))
    rows = with_registry(logged, registry).select("seq", "session_id", "student_id", "total_score", "found", "valid", *DETAIL_NAMES)
    # one grade for each pair, the first
    known = stored.groupBy("session_id", "student_id").agg(F.min_by("final_score", "scan_id").alias("final_score"))
    return _in_groups(rows).groupBy("pairs").transformWithStateInPandas(_FirstScan(), f"{GRADED}, {DETAILS}", "append", "none", _in_groups(known).groupBy("pairs"))


def accepted_stream(submissions: DataFrame, registry: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Only the scans that count, by the engine's own state: one of each pair, of an earlier micro-batch before a later one and any within one."""
    rows = with_registry(submissions, registry).filter("found AND valid")
    if watermark:
        rows = rows.withWatermark(*watermark)
        return rows.dropDuplicatesWithinWatermark(["session_id", "student_id"])
    return rows.dropDuplicates(["session_id", "student_id"])


def run_to_files(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Starts the stream into Parquet files; exactly once by its checkpoint. With `available_now` it ends with the input."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _next_id(spark: SparkSession, path: str, stream: str, number: int) -> int:
    """The scan ids given before a batch of a stream, from the names of the store's folders: no grade is read."""
    if not exists(spark, path):
        return 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    found = [dict(x.split("=", 1) for x in n.split(",")) for n in names if n.startswith("upto=")]
    return max((int(x["upto"]) for x in found if (x["stream"], int(x["batch"])) != (stream, number)), default=0)


def run_to_store(graded: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Starts a stream of verdicts with details (`grade_stream_from`) that adds the grades that count to the store at `path`, as SCHEMAS["grades"] has them.

    A batch is a folder whose name has the last scan id, the stream (by its checkpoint) and the batch's number. It is written elsewhere and then
    renamed, so that readers see all of it or nothing; a batch that runs again finds its folder and leaves it. Scan ids go on from the
    greatest that a name has, in order of arrival.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        done = fs.globStatus(fs_path(f"{path}/upto=*,stream={stream},batch={number}"))
        if done:
            return
        before = _next_id(spark, path, stream, number)
        kept = batch.filter("verdict = 'success'").withColumnRenamed("total_score", "final_score").withColumn("timestamp", F.current_timestamp())
        rows = numbered(kept.persist(), "seq", "scan_id").withColumn("scan_id", F.col("scan_id") + before)
        last = before + kept.count()
        written = f"{path}/_new-{stream}-{number}"
        rows.select(*schema("grades").names).write.mode("overwrite").parquet(written)
        kept.unpersist()
        if not fs.rename(fs_path(written), fs_path(f"{path}/upto={last},stream={stream},batch={number}")):
            raise OSError(f"{written} could not be renamed")

    writer = graded.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_versions(graded: DataFrame, table: VersionedTable, checkpoint: str, available_now: bool = True):
    """Starts a stream of verdicts with details (`grade_stream_from`) that adds the grades that count to a table in versions, keyed by session and student.

    Each batch is a commit by the name of its stream and number, so that one that runs again changes nothing. Several streams may add to
    one table: of two grades of a pair the one committed first stays, and scan ids have neither gaps nor repeats.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(batch: DataFrame, number: int) -> None:
        kept = batch.filter("verdict = 'success'").withColumnRenamed("total_score", "final_score").withColumn("timestamp", F.current_timestamp())
        table.add(kept, "seq", f"{stream}/{number}", "scan_id")

    writer = graded.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Grades that streams have written; none where no store is."""
    if not exists(spark, path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(path)
