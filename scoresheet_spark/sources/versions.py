"""A table of keyed rows in versions: a commit is there whole or not at all, and rewrites only the buckets of its keys.

    <path>/versions/<number>.json              a version: which folders hold each bucket, and the next number to give
    <path>/commits/<digest>                    a mark for each commit, by the name its writer gave it
    <path>/data/<folder>/_slot=<n>/*.parquet  rows; folders that no version names are leftovers of writers that stopped

A bucket is a hash of the key, so that a version's size depends on the number of buckets and not on the rows. A version's file is made
under its number only if there is none: of two writers one wins, and the other goes on from the winner's version.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.grading import numbered

#: Times that a commit begins again behind other writers before it gives up.
ATTEMPTS = 20
BUCKET = "_slot"


class Conflict(RuntimeError):
    """Other writers were faster each time."""


@dataclass(frozen=True)
class Version:
    """One state of the table. `touched` are the buckets that its commit changed."""

    number: int
    commit: str
    schema: str
    key: list[str]
    buckets: int
    next_id: int = 1
    folders: dict[str, list[str]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    touched: list[int] = field(default_factory=list)


class VersionedTable:
    """Rows with one key each under `path`, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = 64) -> VersionedTable:
        """The table at `path`, made with no rows where there is none; one with another schema, key or number of buckets is an error."""
        made = cls(spark, path)
        if not made.exists():
            made._publish(Version(0, "", schema.json(), list(key), buckets))
        first = made.version(0)
        if (json.loads(first.schema), first.key, first.buckets) != (json.loads(schema.json()), list(key), buckets):
            raise ValueError(f"another table is at {path}")
        return made

    # ---- versions

    def exists(self) -> bool:
        return self._fs.exists(self._hadoop(f"{self.path}/versions/{0:012d}.json"))

    def numbers(self) -> list[int]:
        """Versions that are kept, oldest first."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(f"{self.path}/versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int) -> Version:
        stream = self._fs.open(self._hadoop(f"{self.path}/versions/{number:012d}.json"))
        try:
            return Version(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def latest(self) -> Version:
        return self.version(self.numbers()[-1])

    def history(self) -> DataFrame:
        """(number, commit, n_rows, n_touched, n_folders) of the versions that are kept."""
        kinds = "number bigint, commit string, rows map<string,bigint>, touched array<int>, folders map<string,array<string>>"
        read = self.spark.read.schema(kinds).option("pathGlobFilter", "*.json").json(f"{self.path}/versions")
        total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)
        folders = total(F.transform(F.map_values("folders"), lambda x: F.size(x).cast("bigint")))
        return read.select("number", "commit", total(F.map_values("rows")).alias("n_rows"), F.size("touched").alias("n_touched"), folders.alias("n_folders"))

    # ---- reading

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless told."""
        version = self.latest() if number is None else self.version(number)
        return self._rows(version, sorted(map(int, version.folders)))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among `keys`; only their buckets are read."""
        version = self.latest()
        keys = keys.select(*version.key).distinct()
        return self._among(self._rows(version, self._slots(self._slotted(keys, version))), keys, version, "left_semi")

    def _rows(self, version: Version, buckets: list[int]) -> DataFrame:
        kind = StructType.fromJson(json.loads(version.schema))
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b in buckets for folder in version.folders.get(str(b), [])]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    # ---- commits

    def put(self, rows: DataFrame, seq: str, commit: str | None = None) -> int:
        """Rows in place of those with the same key, of one key's rows the last by `seq`; tells the version that has them.

        Null keys are a key like any other. `seq` need not be a column of the table. A `commit` that has been there before changes nothing.
        """
        return self._commit(self._winners(rows, seq, F.max), self._put, commit)

    def add(self, rows: DataFrame, seq: str, commit: str | None = None, number: str | None = None) -> int:
        """Rows whose key the table does not have yet, of one key's rows the first by `seq`; rows that are there stay as they are.

        They go into folders of their own beside the bucket's others (see `compact`). With `number`, that column counts on without gaps from
        the last row that got a number, in the order of `seq`, a unique integer.
        """
        return self._commit(self._winners(rows, seq, F.min), lambda given, base: self._add(given, base, number), commit, numbering=bool(number))

    def remove(self, keys: DataFrame, commit: str | None = None) -> int:
        """Takes the rows with these keys out."""
        return self._commit(keys.select(*self.latest().key).distinct(), self._remove, commit)

    def compact(self, most: int = 4) -> int:
        """Writes buckets of more than `most` folders again, as one each; rows stay the same."""
        base = self.latest()
        many = sorted(int(b) for b, folders in base.folders.items() if len(folders) > most)
        if not many:
            return base.number
        rows = self._slotted(self._rows(base, many), base)
        made, counts = self._write(rows, base)
        done = replace(
            base, number=base.number + 1, commit=f"compact-{made}", touched=many,
            folders={**base.folders, **{str(b): [made] for b in many}}, rows={**base.rows, **counts},
        )
        if not self._publish(done):
            raise Conflict("another commit came first; compact again")
        return done.number

    def _put(self, given: DataFrame, base: Version) -> Version:
        touched = self._slots(given)
        wanted = [f.name for f in StructType.fromJson(json.loads(base.schema))]
        old = self._slotted(self._among(self._rows(base, touched), given, base, "left_anti"), base)
        return self._rewritten(old.unionByName(given.select(*wanted, BUCKET)), touched, base)

    def _remove(self, given: DataFrame, base: Version) -> Version:
        touched = [b for b in self._slots(given) if str(b) in base.folders]
        return self._rewritten(self._slotted(self._among(self._rows(base, touched), given, base, "left_anti"), base), touched, base)

    def _rewritten(self, rows: DataFrame, touched: list[int], base: Version) -> Version:
        """The version in which the touched buckets have these rows; a bucket without rows has no folder."""
        made, counts = self._write(rows, base)
        gone = set(map(str, touched))
        return replace(
            base, number=base.number + 1, touched=touched,
            folders={**{b: f for b, f in base.folders.items() if b not in gone}, **{b: [made] for b in counts}},
            rows={**{b: n for b, n in base.rows.items() if b not in gone}, **counts},
        )

    def _add(self, given: DataFrame, base: Version, number: str | None) -> Version:
        fresh = self._among(given, self._rows(base, self._slots(given)), base, "left_anti")
        if number:
            fresh = numbered(fresh.drop(number), "_seq", number).withColumn(number, F.col(number) + (base.next_id - 1))
        made, counts = self._write(fresh.select(*(f.name for f in StructType.fromJson(json.loads(base.schema))), BUCKET), base)
        return replace(
            base, number=base.number + 1, touched=sorted(map(int, counts)), next_id=base.next_id + (sum(counts.values()) if number else 0),
            folders={**base.folders, **{b: [*base.folders.get(b, []), made] for b in counts}},
            rows={**base.rows, **{b: base.rows.get(b, 0) + n for b, n in counts.items()}},
        )

    def _commit(self, rows: DataFrame, make: Callable[[DataFrame, Version], Version], commit: str | None, numbering: bool = False) -> int:
        """Publishes what `make` gives for the rows on top of the latest version.

        Behind another writer that touched none of the same buckets, what has been written is taken over into the newer version; else it
        is made again. The rows are written once before, so that they are the same each time, a clock's included.
        """
        commit = commit or uuid.uuid4().hex
        base = self.latest()
        self._mark(base)
        if self._marked(commit):
            return base.number
        staged = f"{self.path}/data/given-{uuid.uuid4().hex}"
        try:
            self._slotted(rows, base).write.parquet(staged)
            given = self.spark.read.parquet(staged)
            done = make(given, base)
            for _ in range(ATTEMPTS):
                if self._publish(replace(done, commit=commit)):
                    self._mark(replace(done, commit=commit))
                    return done.number
                between = [self.version(n) for n in self.numbers() if n >= done.number]
                for v in between:
                    self._mark(v)
                    if v.commit == commit:
                        return v.number
                newest, theirs = between[-1], {b for v in between for b in v.touched}
                if numbering or theirs & set(self._slots(given)):
                    done = make(given, newest)
                    continue
                mine = {str(b) for b in done.touched}
                take = lambda new, old: {**{b: x for b, x in old.items() if b not in mine}, **{b: new[b] for b in mine if b in new}}
                done = replace(newest, number=newest.number + 1, touched=done.touched, folders=take(done.folders, newest.folders), rows=take(done.rows, newest.rows))
            raise Conflict(f"{ATTEMPTS} attempts of commit {commit}")
        finally:
            self._fs.delete(self._hadoop(staged), True)

    def _winners(self, rows: DataFrame, seq: str, best: Callable) -> DataFrame:
        """One row for each key, by a sum before the shuffle, with the columns of the table that there are (else null) and `_seq`."""
        base = self.latest()
        kind = StructType.fromJson(json.loads(base.schema))
        have = set(rows.columns)
        cell = lambda f: (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        rest = [f for f in kind if f.name not in base.key]
        picked = rows.select(*(cell(kind[k]) for k in base.key), F.struct(F.col(f"`{seq}`").alias("_seq"), *map(cell, rest)).alias("_row"))
        return picked.groupBy(*base.key).agg(best("_row").alias("_row")).select(*base.key, "_row.*")

    def _write(self, rows: DataFrame, base: Version) -> tuple[str, dict[str, int]]:
        """Writes rows into a new folder, a task for each bucket or several; tells its name and the rows of each bucket in it."""
        made = uuid.uuid4().hex
        rows.repartition(base.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{made}")
        kind = StructType.fromJson(json.loads(base.schema)).add(BUCKET, "integer")
        counts = self.spark.read.schema(kind).parquet(f"{self.path}/data/{made}").groupBy(BUCKET).count().collect()  # one for each bucket
        return made, {str(r[BUCKET]): r["count"] for r in counts}

    def _slotted(self, rows: DataFrame, base: Version) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*base.key), F.lit(base.buckets)).cast("int"))

    def _slots(self, rows: DataFrame) -> list[int]:
        """Buckets that rows lie in: no more than the table has."""
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def _among(self, rows: DataFrame, keys: DataFrame, base: Version, how: str) -> DataFrame:
        named = keys.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(base.key)))
        same = F.lit(True)
        for i, k in enumerate(base.key):
            same = same & rows[k].eqNullSafe(named[f"_key_{i}"])
        return rows.join(named, same, how)

    # ---- files

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _publish(self, version: Version) -> bool:
        """Makes the version's file unless there is one of its number, and tells whether it did."""
        jvm = self.spark._jvm
        staged, target = self._hadoop(f"{self.path}/versions/_{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/versions/{version.number:012d}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename would replace the other's file there, a link does not
                here = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(here(target), here(staged))
            else:
                kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self.spark.sparkContext._gateway.new_array(kinds, 1)
                options[0] = kinds.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(staged, False)
        return True

    def _commit_path(self, commit: str):
        return self._hadoop(f"{self.path}/commits/{hashlib.sha256(commit.encode()).hexdigest()}")

    def _marked(self, commit: str) -> bool:
        return self._fs.exists(self._commit_path(commit))

    def _mark(self, version: Version) -> None:
        """Marks a version's commit as done. Each writer does so for the version it starts from, whose writer may have stopped before."""
        if version.commit and not self._marked(version.commit):
            self._fs.create(self._commit_path(version.commit), True).close()

    def vacuum(self, keep: int = 1, older_than_hours: float = 24.0) -> int:
        """Drops all but the last `keep` versions, and folders that no kept version names and nobody changed for a while; tells how many folders.

        A writer at work has folders that no version names yet: the time must be longer than a commit takes.
        """
        numbers = self.numbers()
        for v in map(self.version, numbers):
            self._mark(v)
        # the first version's file stays: it says what table this is
        for n in numbers[1 : max(1, len(numbers) - keep)]:
            self._fs.delete(self._hadoop(f"{self.path}/versions/{n:012d}.json"), False)
        used = {f for n in self.numbers() for folders in self.version(n).folders.values() for f in folders}
        data, dropped = self._hadoop(f"{self.path}/data"), 0
        before = self.spark._jvm.System.currentTimeMillis() - older_than_hours * 3_600_000
        for f in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if f.getPath().getName() not in used and f.getModificationTime() <= before:
                dropped += bool(self._fs.delete(f.getPath(), True))
        return dropped
