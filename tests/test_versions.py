"""Tables in versions: whole commits, writers at the same time, writers that stop."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scoresheet_spark.sources.versions import Conflict, VersionedTable

KIND = StructType().add("k", "string").add("v", "integer").add("id", "long")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, v int, seq bigint")


def seen(df):
    return sorted((r.k or "", r.v) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark, str(tmp_path / "t"), KIND, ["k"], 8)


def test_put_keeps_the_last_row_of_a_key_and_older_versions(spark, table):
    assert table.read().count() == 0 and table.read().schema == KIND
    one = table.put(rows(spark, ("a", 1, 1), ("b", 2, 2), ("a", 3, 3), (None, 4, 4)), "seq")
    two = table.put(rows(spark, ("a", 9, 1), ("c", 5, 1), (None, 6, 2)), "seq")
    assert (one, two) == (1, 2)
    assert seen(table.read(one)) == [("", 4), ("a", 3), ("b", 2)]
    assert seen(table.read()) == [("", 6), ("a", 9), ("b", 2), ("c", 5)]
    assert [tuple(r)[::2] for r in table.history().orderBy("number").select("number", "commit", "n_rows").collect()] == [(0, 0), (1, 3), (2, 4)]


def test_a_commit_that_runs_again_changes_nothing(spark, table):
    first = table.put(rows(spark, ("a", 1, 1)), "seq", "import-1")
    table.put(rows(spark, ("a", 2, 1)), "seq", "import-2")
    assert table.put(rows(spark, ("a", 1, 1)), "seq", "import-1") == 2 and first == 1
    assert seen(table.read()) == [("a", 2)]


def test_buckets_without_rows_of_a_commit_keep_their_folders(spark, table):
    table.put(spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), "id"), "id")
    before = table.latest()
    table.put(rows(spark, ("7", 2, 1)), "seq")
    after = table.latest()
    assert len(after.touched) == 1 and len(before.folders) == 8
    assert sum(before.folders[b] != after.folders[b] for b in before.folders) == 1
    found = table.lookup(spark.createDataFrame([("7",), ("nobody",)], "k string"))
    assert seen(found) == [("7", 2)] and len(found.inputFiles()) < len(table.read().inputFiles())


def test_add_keeps_what_is_there_and_counts_on(spark, table):
    table.add(rows(spark, ("a", 1, 5), ("b", 2, 3), ("a", 7, 4)), "seq", number="id")
    table.add(rows(spark, ("a", 9, 1), (None, 8, 9), ("c", 3, 6), (None, 7, 8)), "seq", number="id")
    table.add(rows(spark, ("c", 9, 1), (None, 9, 2)), "seq", number="id")
    assert sorted((r.id, r.k, r.v) for r in table.read().collect()) == [(1, "b", 2), (2, "a", 7), (3, "c", 3), (4, None, 7)]
    assert table.latest().next_id == 5


def test_a_writer_that_stops_leaves_the_old_version(spark, table, monkeypatch):
    table.put(rows(spark, ("a", 1, 1)), "seq")

    def stop(version):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", stop)
        with pytest.raises(OSError):
            table.put(rows(spark, ("a", 2, 1), ("b", 2, 1)), "seq", "x")
    assert seen(table.read()) == [("a", 1)]
    assert table.vacuum(keep=9, older_than_hours=-1.0) == 1
    table.put(rows(spark, ("a", 2, 1), ("b", 2, 1)), "seq", "x")
    assert seen(table.read()) == [("a", 2), ("b", 2)]


def test_a_writer_that_stops_before_its_mark_has_committed(spark, table, monkeypatch):
    def stop(version):
        if version.commit:
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_mark", stop)
        with pytest.raises(OSError):
            table.add(rows(spark, ("a", 1, 1)), "seq", "x", "id")
    assert table.add(rows(spark, ("a", 1, 1), ("b", 1, 2)), "seq", "x", "id") == 1
    assert seen(table.read()) == [("a", 1)]


@pytest.mark.parametrize("other", ["a", "b", "c", "d", "e"])
@pytest.mark.parametrize("numbered", [False, True])
def test_of_two_writers_neither_is_lost(spark, table, monkeypatch, other, numbered):
    """Another commit comes between writing and publishing, with the same key, other buckets, or perhaps the same bucket."""
    twin = VersionedTable(spark, table.path)
    table.put(rows(spark, ("a", 0, 0), ("z", 0, 0)), "seq")
    real, left = table._publish, [1]

    def late(version):
        if left:
            left.pop()
            twin.add(rows(spark, (f"{other}-new", 2, 1)), "seq", number="id") if numbered else twin.put(rows(spark, (other, 2, 1)), "seq")
        return real(version)

    monkeypatch.setattr(table, "_publish", late)
    if numbered:
        table.add(rows(spark, ("a", 5, 1), ("q", 1, 1)), "seq", number="id")
        assert seen(table.read()) == sorted([("a", 0), ("z", 0), ("q", 1), (f"{other}-new", 2)])
        assert sorted(r.id for r in table.read().collect() if r.id) == [1, 2]
    else:
        table.put(rows(spark, ("a", 1, 1)), "seq")
        assert seen(table.read()) == sorted({"z": 0, other: 2, "a": 1}.items())
    assert table.latest().number == 3


def test_writers_that_always_come_late_are_told(spark, table, monkeypatch):
    twin = VersionedTable(spark, table.path)
    real = table._publish
    monkeypatch.setattr("scoresheet_spark.sources.versions.ATTEMPTS", 2)
    monkeypatch.setattr(table, "_publish", lambda v: (twin.put(rows(spark, ("b", v.number, 1)), "seq"), real(v))[1])
    with pytest.raises(Conflict):
        table.put(rows(spark, ("a", 1, 1)), "seq")


def test_compact_remove_and_vacuum(spark, table):
    for i in range(4):
        table.add(spark.range(i * 40, i * 40 + 40).select(F.col("id").cast("string").alias("k"), F.lit(i).alias("v"), "id"), "id")
    before = seen(table.read())
    table.compact(most=2)
    assert seen(table.read()) == before and all(len(f) == 1 for f in table.latest().folders.values())
    assert table.compact(most=2) == table.latest().number
    table.remove(spark.range(0, 80).select(F.col("id").cast("string").alias("k")))
    assert table.read().count() == 80 and sum(table.latest().rows.values()) == 80
    assert table.vacuum(older_than_hours=-1.0) == 5
    assert table.numbers() == [0, 6] and table.read().count() == 80
    table.remove(table.read())
    assert table.read().count() == 0 and not table.latest().folders


def test_nothing_in_and_another_table(spark, table):
    table.put(rows(spark), "seq")
    table.add(rows(spark), "seq", number="id")
    assert table.read().count() == 0 and table.latest().number == 2
    assert VersionedTable.create(spark, table.path, KIND, ["k"], 8).latest().number == 2
    with pytest.raises(ValueError):
        VersionedTable.create(spark, table.path, KIND, ["v"], 8)
