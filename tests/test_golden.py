"""Hand-made rows for the semantics that decide correctness."""

import io
import json
import os
import socket
import uuid
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoresheet_spark.functions import geometry, text
from scoresheet_spark.operators import autolabel, blueprint, detect, grading, infer, labels, positions, roster
from scoresheet_spark.sources import config, images, packets, schemas, workbook
from scoresheet_spark.sources import labels as files
from scoresheet_spark.streaming import log, submissions


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


# --- rosters


def test_import_cleans_headers_and_cells(spark):
    df = spark.createDataFrame([("\t7 ", " Ann\n", " 1 "), (None, "Gone", "1"), ("8", "Bob", "1.0"), ("9", "  ", "1")], " `ID ` string, `Name` string, `S6` string")
    got = by(roster.clean_roster(df, "G"), "student_id", "student_name", "is_present", "group_name")
    assert got == {"7": ("Ann", 1, "G"), "8": ("Bob", 0, "G")}
    assert roster.clean_roster(df, "G", reject_blank_names=False).count() == 3


def test_import_needs_its_columns_and_defaults_to_present(spark):
    with pytest.raises(ValueError, match="name"):
        roster.clean_roster(spark.createDataFrame([("1",)], "id string"), "G")
    assert roster.clean_roster(spark.createDataFrame([("1", "A")], "id string, name string"), "G").first()["is_present"] == 1
    legacy = roster.clean_roster(spark.createDataFrame([("101", "A")], "id string, name string"), "G", legacy_numeric_ids=True)
    assert legacy.first()["student_id"] == "101.0"


def test_reimport_moves_a_student(spark):
    kind = "student_id string, student_name string, is_present int, group_name string"
    old = spark.createDataFrame([("1", "A", 1, "G1"), ("2", "B", 1, "G1")], kind)
    new = spark.createDataFrame([("1", "A2", 0, "G2", 1), ("1", "A3", 1, "G3", 2)], kind + ", seq long")
    assert by(roster.upsert(old, new), "student_id", "student_name", "group_name") == {"1": ("A3", "G3"), "2": ("B", "G1")}


def test_groups_leave_out_blank_ones_and_export_reads_absent(spark):
    df = spark.createDataFrame([("1", "A", 1, "G"), ("2", "B", None, "G"), ("3", "C", 0, ""), ("4", "D", 1, None)], schemas.SCHEMAS["roster"].replace(" NOT NULL", ""))
    assert by(roster.group_counts(df), "group_name", "n_students") == {"G": 2}
    assert by(roster.export(df, "G"), "ID", "Status") == {"1": "Present", "2": "Absent"}
    assert roster.group_size(df, "none").first()[0] == 0


# --- grading

REGISTRY = "student_id string, student_name string"
PAYLOAD = {"action": "submit", "session_id": "s", "student_id": "1", "mcq_score": 18, "essay_scores": [2, 3], "total_score": 23, "mistakes": [{"q": 4, "student_ans": "A", "correct_ans": "B"}]}


def graded(spark, payloads):
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "seq long, payload string")
    return grading.grade(grading.parse_payloads(rows), spark.createDataFrame([("1", "Ann"), ("2", "Bob")], REGISTRY))


def test_first_scan_counts_and_later_ones_hear_of_it(spark):
    df = graded(spark, [PAYLOAD, {**PAYLOAD, "total_score": 9}, {**PAYLOAD, "student_id": "77"}, {**PAYLOAD, "mcq_score": None}, {**PAYLOAD, "session_id": "t", "mcq_score": None}, {**PAYLOAD, "session_id": "t", "mcq_score": 2.5}, {**PAYLOAD, "session_id": None}])
    got = by(grading.response(df), "seq", "status", "error_type", "total_score", "previous_score")
    assert got == {
        0: ("success", None, 23.0, None),
        1: ("error", "duplicate_id", None, 23.0),
        2: ("error", "id_not_found", None, None),
        3: ("error", "duplicate_id", None, 23.0),
        4: ("error", "invalid_payload", None, None),
        5: ("success", None, 23.0, None),
        6: ("error", "invalid_payload", None, None),
    }
    kept = by(grading.stored_grades(df), "scan_id", "session_id", "mcq_score", "essay_total", "final_score")
    assert kept == {1: ("s", 18.0, 5.0, 23.0), 2: ("t", 2.5, 5.0, 23.0)}
    assert df.count() == 7


def test_missing_lists_are_empty(spark):
    rows = spark.createDataFrame([(0, '{"student_id":"1"}'), (1, '{"essay_scores":null,"mistakes":null}'), (2, '{"essay_scores":[2.5,0.5]}')], "seq long, payload string")
    df = grading.parse_payloads(rows)
    assert by(df.select("seq", grading.essay_total(F.col("essay_scores")).alias("t"), F.size("mistakes").alias("m")), "seq", "t", "m") == {0: (0.0, 0), 1: (0.0, 0), 2: (3.0, 0)}


def test_numbers_have_no_gaps_across_buckets(spark):
    df = positions.ordinals(spark.createDataFrame([(v,) for v in (5, 1, 999, 12, 100)], "v long"), "v", width=10)
    assert by(df, "v", "ordinal", "total") == {1: (1, 5), 5: (2, 5), 12: (3, 5), 100: (4, 5), 999: (5, 5)}


def test_sparse_values_are_numbered_at_every_level(spark):
    values = [-(2**62), -7, -1, 0, 1, 9, 10, 2**40, 2**40 + 1, 2**62]
    df = positions.ordinals(spark.createDataFrame([(v,) for v in reversed(values)], "v long"), "v", width=10)
    assert by(df, "v", "ordinal") == {v: i + 1 for i, v in enumerate(values)}
    small = grading.numbered(spark.createDataFrame([(v,) for v in range(0, 400, 3)], "v long"), "v", "n", width=4, fan=3)
    assert by(small, "v", "n") == {v: i + 1 for i, v in enumerate(range(0, 400, 3))}


def test_stream_gives_the_verdicts_of_the_batch(spark, tmp_path):
    payloads = [{**PAYLOAD, "student_id": str(i % 4), "session_id": "st"[i % 2], "mcq_score": None if i < 3 else i, "total_score": i} for i in range(40)]
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)]
    registry = spark.createDataFrame([("1", "Ann"), ("2", "Bob")], REGISTRY)
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, "seq long, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = submissions.read_messages(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, maxFilesPerTrigger="2")
    stream = submissions.read_payloads(source)
    submissions.run_to_files(submissions.grade_stream(stream, registry), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = grading.grade(grading.parse_payloads(spark.createDataFrame(rows, "seq long, payload string")), registry)
    assert by(spark.read.parquet(str(tmp_path / "out")), "seq", "verdict", "previous_score") == {s: (v, p if v == "duplicate_id" else None) for s, (v, p) in by(batch, "seq", "verdict", "previous_score").items()}
    listener = log.ProgressLog()
    spark.streams.addListener(listener)
    submissions.run_to_files(submissions.accepted_stream(stream, registry), str(tmp_path / "ok"), str(tmp_path / "ok-state")).awaitTermination()
    spark.streams.removeListener(listener)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == batch.filter("verdict = 'success'").count()


def test_python_is_called_for_a_group_of_pairs_and_not_for_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(submissions, "GROUPS", 3)
    monkeypatch.setattr(submissions, "PART", 7)
    calls, judge = spark.sparkContext.accumulator(0), submissions._first_wins

    def counted(key, batches, state):
        calls.add(1)
        return judge(key, batches, state)

    monkeypatch.setattr(submissions, "_first_wins", counted)
    payloads = [{**PAYLOAD, "student_id": None if i == 90 else str(i % 29), "session_id": None if i % 31 == 7 else "st"[i % 2], "mcq_score": None if i % 5 == 0 else i, "total_score": i} for i in range(400)]
    rows = [(400 - i, json.dumps(p)) for i, p in enumerate(payloads)]
    registry = spark.createDataFrame([(str(i), "x") for i in range(20)], REGISTRY)
    for n, part in enumerate((rows[200:], rows[:200])):
        spark.createDataFrame(part, "seq long, value string").write.parquet(str(tmp_path / f"in{n}"))
        source = submissions.read_messages(spark, str(tmp_path / "in*"), spark.read.parquet(str(tmp_path / "in0")).schema)
        submissions.run_to_files(submissions.grade_stream(submissions.read_payloads(source), registry), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = grading.grade(grading.parse_payloads(spark.createDataFrame(rows, "seq long, payload string")), registry)
    assert by(spark.read.parquet(str(tmp_path / "out")), "seq", "verdict", "previous_score") == {s: (v, p if v == "duplicate_id" else None) for s, (v, p) in by(batch, "seq", "verdict", "previous_score").items()}
    assert calls.value <= 6


def test_groups_of_stored_pairs_come_in_parts(spark):
    known = {("s", str(i)): float(i) for i in range(1000)}
    assert submissions._unpacked(submissions._packed(known)) == known and submissions._unpacked(submissions._packed({})) == {}

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    scan = submissions._FirstScan()
    scan.scores = Value()
    for a, b in ((0, 600), (600, 1000)):
        scan.handleInitialState((0,), pd.DataFrame({"session_id": "s", "student_id": [str(i) for i in range(a, b)], "final_score": np.arange(a, b)}), None)
    assert scan._known() == known
    sent = {"seq": [5, 4, 3, 9], "session_id": "s", "student_id": ["7", "n", "n", "m"], "total_score": [1.0, 2.0, 3.0, 4.0], "found": True, "valid": [True, True, False, True], "mcq_score": [1.0, 2.0, None, 4.0], "essay_total": 0.5, "mistakes_log": list("abcd")}
    got = pd.concat(scan.handleInputRows((0,), iter([pd.DataFrame(sent).iloc[:2], pd.DataFrame(sent).iloc[2:]]), None))
    rows = [(r.seq, r.verdict, None if pd.isna(r.previous_score) else r.previous_score, None if pd.isna(r.mcq_score) else r.mcq_score, r.mistakes_log) for r in got.itertuples()]
    assert rows == [(3, "invalid_payload", None, None, None), (4, "success", None, 2.0, "b"), (5, "duplicate_id", 7.0, None, None), (9, "success", None, 4.0, "d")]
    assert scan._known() == {**known, ("s", "n"): 2.0, ("s", "m"): 4.0}


# --- labels


def test_label_lines(spark):
    lines = ["0 .5 .5 .1 .2", "1\t.5\t.5\t.1\t.2\textra", "2 .5 .5", "", "1.0 .5 .5 .1 .2"]
    got = files.parse_label_lines(spark.createDataFrame([("p", v) for v in lines], "path string, value string")).collect()
    assert [(r.class_id, r.cx, r.bh) for r in got] == [(0, 0.5, 0.2), (1, 0.5, 0.2), (None, 0.5, 0.2)]


def test_six_decimals_round_the_exact_value(spark):
    df = spark.createDataFrame([(v,) for v in (0.1234565, 0.1234575, 0.0000005)], "v double")
    assert [r[0] for r in df.select(text.six_decimals("v")).collect()] == ["0.123456", "0.123457", "0.000000"]


def test_label_files_cover_images_without_boxes_and_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([("a.jpg", 1, 0.5, 0.25, 0.1, 0.2), ("a.jpg", 0, 0.1, 0.2, 0.3, 0.4)], "path string, class_id int, cx double, cy double, bw double, bh double")
    images = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "path string")
    got = by(files.label_files(images, boxes), "path", "text")
    assert got == {"a.jpg": "0 0.100000 0.200000 0.300000 0.400000\n1 0.500000 0.250000 0.100000 0.200000", "b.jpg": ""}
    shots = spark.createDataFrame([(f"{tmp_path}/a/x.jpg",), (f"{tmp_path}/b/x y.jpg",), (f"{tmp_path}/b/z.png",)], "path string")
    drawn = spark.createDataFrame([(f"{tmp_path}/a/x.jpg", 2, 9, 0.5, 0.25, 0.1, 0.2), (f"{tmp_path}/a/x.jpg", 1, 3, 0.1, 0.2, 0.3, 0.4), (f"{tmp_path}/b/z.png", 1, 0, 0.5, 0.5, 0.5, 0.5)], "path string, seq int, class_id int, cx double, cy double, bw double, bh double")
    for _ in range(2):  # writing again leaves the same files
        told = by(files.write_label_files(files.label_files(shots, drawn)), "label_path", "length")
    assert told[f"{tmp_path}/b/x y.txt"] == 0 and (tmp_path / "b" / "x y.txt").read_bytes() == b""
    assert sorted(p.name for p in tmp_path.rglob("*.*") if p.suffix != ".crc") == ["x y.txt", "x.txt", "z.txt"]
    read = sorted((r.path.rpartition("/")[2], r.seq, r.class_id) for r in files.read_labels(spark, str(tmp_path)).collect())
    assert read == [("x.txt", 0, 3), ("x.txt", 1, 9), ("z.txt", 0, 0)]  # in the order drawn
    urls = shots.select(F.concat(F.lit("file:"), "path").alias("path"))
    assert [r[0] for r in labels.unlabelled(urls, files.list_label_files(spark, str(tmp_path))).collect()] == [f"file:{tmp_path}/b/x y.jpg"]


def test_class_lists(spark, tmp_path):
    (tmp_path / "classes.txt").write_text(" pen \n\ncat\r\ndog\n")
    classes = files.read_class_names(spark, str(tmp_path / "classes.txt"))
    assert by(classes, "class_id", "name") == {0: "pen", 1: "cat", 2: "dog"}
    assert files.class_list_text(classes).first()[0] == "pen\ncat\ndog\n"
    names = spark.createDataFrame([(1, "cat"), (2, " owl "), (3, "owl"), (4, " ")], "seq int, name string")
    assert by(labels.append_classes(classes, names), "class_id", "name") == {0: "pen", 1: "cat", 2: "dog", 3: "owl"}
    assert by(labels.delete_class(classes, 0), "class_id", "name") == {0: "cat", 1: "dog"}
    boxes = spark.createDataFrame([(0,), (1,), (7,)], "class_id int")
    assert sorted(r.class_name for r in labels.named(boxes, classes).collect()) == ["cat", "cls7", "pen"]
    assert sorted(r[0] for r in labels.remap_labels(boxes, 0).collect()) == [0, 6]


def test_what_is_unlabelled(spark):
    images = spark.createDataFrame([("x/a.jpg",), ("x/b.png",), ("x/c.JPG",), ("x/a.png",)], "path string")
    found = spark.createDataFrame([("x/a.txt", 10), ("x/b.txt", 0)], "label_path string, length long")
    assert sorted(r[0] for r in labels.unlabelled(images, found).collect()) == ["x/b.png", "x/c.JPG"]
    assert by(labels.label_collisions(images), "label_path", "n_images") == {"x/a.txt": 2}


def test_boxes_are_edited(spark):
    boxes = spark.createDataFrame([(1, 5), (2, 6)], "id int, class_id int")
    assert by(labels.reclassify(boxes, F.col("id") == 1, 9), "id", "class_id") == {1: 9, 2: 6}
    assert by(labels.delete_boxes(boxes, boxes.filter("id = 1"), ["id"]), "id", "class_id") == {2: 6}
    assert by(labels.insert_boxes(boxes, spark.createDataFrame([(3, None)], "id int, class_id int"), None), "id", "class_id")[3] == 0


# --- geometry and detection


def test_quarter_turns_move_boxes_as_arrays_turn(spark):
    for turns in range(4):
        image = np.zeros((5, 7), int)
        image[1:3, 2:6] = 1
        turned = np.rot90(image, -turns)
        y, x = np.argwhere(turned)[0]
        h, w = np.argwhere(turned)[-1] - (y, x) + 1
        got = one(spark, *geometry.quarter_turns(*map(F.lit, (2, 1, 4, 2, 7, 5, turns))))
        assert got == (x, y, w, h, turned.shape[1], turned.shape[0])


def test_rects(spark):
    assert one(spark, *geometry.upright(*map(F.lit, (5, 5, -3, 2)))) == (2, 5, 3, 2)
    assert one(spark, *geometry.moved_edges(*map(F.lit, (0, 0, 10, 10, "l", 12, 5)))) == (10, 0, 2, 10)
    assert one(spark, geometry.roi(*map(F.lit, (1.9, -1.9, 0.5, 4.0))))[0] is None
    assert tuple(one(spark, geometry.roi(*map(F.lit, (1.9, -1.9, 3.5, 4.0))))[0]) == (1, -1, 3, 4)
    assert one(spark, geometry.near_edges(*map(F.lit, (0.0, 10.0, 6.9, 3.0, 100.0, 14.0))))[0] == "l"


def end_to_end(spark, v, n=1):
    rows = spark.createDataFrame([(1, 640, 640, [list(map(float, v))] * n)], "image_id long, width int, height int, rows array<array<double>>")
    return detect.decode(rows).collect()


def test_end_to_end_keeps_equality_and_both_layouts(spark):
    assert [r.class_id for r in end_to_end(spark, [0.0, 10, 10, 50, 50, 2.5, 0.25])] == [2]
    assert [r.class_id for r in end_to_end(spark, [10.0, 10, 50, 50, 0.25, 3.5])] == [4]
    assert not end_to_end(spark, [0.0, 10, 10, 11, 50, 2, 0.9])
    assert end_to_end(spark, [0.0, -50, 10, 700, 50, 2, 0.9])[0][2:6] == (0.0, 10.0, 639.0, 50.0)


def test_many_rows_are_a_raw_grid(spark):
    assert len(end_to_end(spark, [100.0, 100, 150, 150, 0.9, 0.9], 1000)) == 1
    assert len(end_to_end(spark, [100.0, 100, 150, 150, 0.9, 0.9], 999)) == 999


def grid(spark, *rows):
    return spark.createDataFrame([(1, 640, 640, i, list(map(float, r))) for i, r in enumerate(rows)], "image_id long, width int, height int, anchor_id long, v array<double>")


def test_raw_grid_thresholds_and_first_best_class(spark):
    got = detect.raw_candidates(grid(spark, (9, 9, 4, 4, 0.25, 1, 1), (9, 9, 4, 4, 0.5, 0.5, 0.2), (9, 9, 4, 4, 0.9, 0.4, 0.4)), 0.25).collect()
    assert [(r.anchor_id, r.class_id) for r in got] == [(2, 0)]
    assert detect.raw_candidates(grid(spark, (9, 9, 4, 4, 1, 0.3, 0.9)), n_classes=1).first()["class_id"] == 0


def test_suppression_is_by_class_and_strict(spark):
    rows = grid(spark, (100, 100, 40, 40, 1, 0.9, 0), (102, 100, 40, 40, 1, 0.8, 0), (102, 100, 40, 40, 1, 0, 0.7), (300, 300, 10, 10, 1, 0.5, 0))
    assert sorted(r.anchor_id for r in detect.decode_raw(rows).collect()) == [0, 2, 3]
    half = grid(spark, (100, 100, 40, 40, 1, 0.9, 0), (100, 110, 40, 20, 1, 0.8, 0))
    assert len(detect.decode_raw(half, iou=0.5).collect()) == 2


def test_survivors_overlap_at_most_by_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows = grid(spark, *np.c_[rng.uniform(100, 300, (200, 2)), rng.uniform(40, 90, (200, 2)), rng.uniform(0.3, 1, (200, 3))].tolist())
    kept = detect.suppress(detect.raw_candidates(rows)).collect()
    assert 0 < len(kept) < 200
    for i, a in enumerate(kept):
        for b in kept[:i]:
            if a.class_id == b.class_id:
                w, h = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)), max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
                assert w * h / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - w * h) <= 0.45 + 1e-9


def test_inference_runs_a_model_on_the_executors(spark):
    def load():
        return lambda t: np.array([[[0, 10, 20, 30, 60, 1, float(t.mean()) + 0.5]]], np.float32)

    def read(content):
        return None if content == b"bad" else np.full((20, 40, 3), 128, np.uint8)

    images = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = by(infer.infer(images, load, read, (64, 64)), "path", "width", "height", "rows")
    assert got["b"] == (None, None, None)
    assert got["a"][:2] == (40, 20) and len(got["a"][2]) == 1 and len(got["a"][2][0]) == 7
    assert infer.canvas_of([1, 3, "h", 320]) == (640, 320)
    assert infer.rows_of(np.zeros((1, 0, 7))).shape[0] == 0


def test_auto_labelling(spark):
    runs = spark.sparkContext.accumulator(0)

    def load():
        return lambda t: runs.add(1) or found(t)

    found = lambda t: np.array([[0, 0, 16, 64, 48, 1, 0.9]], np.float32)

    def read(content):
        return None if content == b"bad" else np.full((20, 40, 3), 128, np.uint8)

    images = spark.createDataFrame([("a.jpg", bytearray(b"ok")), ("b.jpg", bytearray(b"bad")), ("c.jpg", bytearray(b"ok"))], "path string, content binary")
    filled = spark.createDataFrame([("c.txt", 9), ("a.txt", 0)], "label_path string, length long")
    got = by(autolabel.auto_label(images, filled, load, read, canvas=(64, 64)), "path", "text")
    assert got == {"a.jpg": "1 0.487500 0.475000 0.975000 0.950000"} and runs.value == 1
    assert set(by(autolabel.auto_label(images, filled, load, read, remaining_only=False, confidence=0.95, canvas=(64, 64)), "path", "text").values()) == {""}


def test_the_model_runs_in_many_tasks_whatever_the_table(spark):
    images = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit(b"ok").alias("content"))
    out = infer.infer(images, lambda: lambda t: np.ones((1, 1, 7), np.float32), lambda c: np.zeros((4, 4, 3), np.uint8), (8, 8))
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and sum(r["count"] for r in tasks) == 400 and max(r["count"] for r in tasks) < 200


def test_templates_are_turned_and_cut(spark):
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    rows = [("p", bytearray(b"x"), 1, 1, 2, 3, 4), ("q", bytearray(b"x"), 0, 90, 0, 3, 4), ("r", bytearray(b"bad"), 0, 0, 0, 1, 1)]
    df = spark.createDataFrame(rows, "path string, content binary, turns int, x int, y int, w int, h int")
    got = by(autolabel.cut_templates(df, lambda c: None if c == b"bad" else image, lambda a: a.tobytes()), "path", "template")
    assert bytes(got["p"]) == np.rot90(image, -1)[2:6, 1:4].tobytes() and got["q"] is None and got["r"] is None


def test_packet_server_answers_every_client(spark):
    students = spark.createDataFrame([("1", "A", 1, "G")], "student_id string, student_name string, is_present int, group_name string")
    packet = blueprint.master_packet(spark.createDataFrame([("m",)], "mode string"), students, "G")
    server = packets.PacketServer(packet).start()
    for _ in range(2):
        with socket.create_connection(server.address) as client:
            assert json.loads(client.makefile().readline())["exam_mode"] == "m"
    server.stop()
    with pytest.raises(ValueError):
        packets.PacketServer(blueprint.master_packet(spark.createDataFrame([("m",)], "mode string"), students, "H"))


def test_small_functions(spark):
    assert one(spark, text.percent(F.lit(0.125)), text.clock(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == (12, "03:04:05")
    assert one(spark, *geometry.moved(F.lit(1), F.lit(2), 10, -1)) == (11, 1)
    assert one(spark, *roster.essay_grid(F.lit(5))) == (1, 4)


# --- blueprints and files


def test_essay_map(spark):
    points = F.array(F.lit(1.5), F.lit(None).cast("double"))
    assert one(spark, blueprint.essay_map(points, F.lit(True)))[0] == {"Q1": 1.5, "Q2": 2.0}
    assert one(spark, blueprint.essay_map(points, F.lit(False)))[0] == {}
    assert one(spark, blueprint.essay_map(F.array().cast("array<double>"), F.lit(True)))[0] == {}
    listed = one(spark, blueprint.essay_list(F.create_map(F.lit("Q10"), F.lit(1.0), F.lit("Q2"), F.lit(3.0))))[0]
    assert [tuple(x) for x in listed] == [(2, 3.0), (10, 1.0)]


def test_config_files_are_replaced_and_merged(spark, tmp_path):
    path = str(tmp_path / "project.json")
    with pytest.raises(FileNotFoundError):
        config.read_config(spark, path)
    start = spark.range(1).select(*(c.alias(n) for n, c in blueprint.first_config("P", "Exam", 5).items()))
    config.write_config(start, path)
    roi = F.struct(*(F.lit(v).alias(n) for n, v in zip("xywh", (1, 2, 3, 4), strict=True)))
    config.write_config(blueprint.save_template(config.read_config(spark, path), F.lit("t.jpg"), roi), path)
    saved = config.read_config(spark, path)
    assert (saved.first()["mcq_count"], saved.first()["template_path"]) == (5, "t.jpg")
    os.rename(path, f"{path}.staged")  # as if a replacement had stopped half-way
    assert config.read_config(spark, path).first()["template_path"] == "t.jpg"
    assert blueprint.save_blueprint(saved, {"mcq_points": F.lit(0.5)}).first()["template_path"] is None
    assert blueprint.save_blueprint(saved, {"mcq_points": F.lit(0.5)}, "merge").first()["template_path"] == "t.jpg"


def test_packet(spark, tmp_path):
    students = spark.createDataFrame([("1", "A", 1, "G"), ("2", "B", 0, "H")], "student_id string, student_name string, is_present int, group_name string")
    empty = spark.createDataFrame([(None,)], "mode string")
    packet = blueprint.master_packet(empty, students, "G", "fallback")
    said = json.loads(blueprint.packet_json(packet).first()[0])
    assert (said["exam_name"], said["exam_mode"], said["roster"]) == ("fallback", "Quiz Mode", [{"id": "1", "name": "A", "present": 1}])
    assert blueprint.master_packet(empty, students, "none").count() == 0
    assert by(blueprint.packet_rows(empty, students, "H", "p"), "id", "exam_name", "name", "present") == {"2": ("p", "B", 0)}
    config.write_packet(packet, str(tmp_path / "packet"))
    assert spark.read.text(str(tmp_path / "packet")).count() == 1


def test_workbooks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "Ann & <Bob>"), ("2", None)], "ID string, Name string")
    workbook.write_workbook(df, str(tmp_path / "book.xlsx"))
    got = workbook.read_workbook(spark, str(tmp_path / "book.xlsx"))
    assert by(got, "ID", "Name") == {"1": "Ann & <Bob>", "2": None}
    workbook.write_workbook(df, str(tmp_path / "book.csv"))
    assert workbook.read_workbook(spark, str(tmp_path / "book.csv")).columns == ["ID", "Name"]


def test_workbooks_of_many_files_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "READ_ROWS", 7)
    folder = str(tmp_path / "books")
    df = spark.range(0, 230, 1, 3).select(F.col("id").cast("string").alias("ID"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a & <"), "id")).alias("a.b"), (F.col("id") > 9).alias("late"))
    workbook.write_workbooks(df, folder, 20)
    books = [open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder) if n.endswith(".xlsx")]
    sizes = [len(workbook.parse_sheet(b)) for b in books]
    assert len(books) == 12 and max(sizes) == 21 and sum(sizes) == 230 + 12
    got = workbook.read_workbook(spark, folder)
    assert got.columns == ["ID", "a.b", "late"]
    assert sorted(map(tuple, got.collect())) == sorted((str(i), f"a & <{i}" if i % 3 else None, str(i > 9)) for i in range(230))
    with pytest.raises(FileExistsError):
        workbook.write_workbooks(df, folder)
    workbook.write_workbooks(df.limit(0), f"{folder}-none")
    assert workbook.read_workbook(spark, f"{folder}-none").count() == 0 and os.listdir(tmp_path).count("books-none") == 1


def test_rows_of_a_sheet_are_parsed_as_they_are_asked_for():
    import tracemalloc

    content = workbook.build_sheet(["a"], ((str(i),) for i in range(20_000)))
    tracemalloc.start()
    assert sum(1 for _ in workbook.sheet_rows(content)) == 20_001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000, peak


def test_store_is_made_once(spark):
    schemas.create_store(spark, "store_test")
    schemas.create_store(spark, "store_test")
    assert spark.table("store_test.grades").columns == schemas.empty(spark, "grades").columns
    spark.sql("DROP DATABASE store_test CASCADE")


def test_sql_with_bound_values(spark):
    schemas.register({"roster": spark.createDataFrame([("1", "A", 1, "G'"), ("2", "B", 1, "H")], schemas.SCHEMAS["roster"])})
    got = schemas.query(spark, "SELECT student_id AS ID FROM roster WHERE group_name = :group", group="G'")
    assert [r.ID for r in got.collect()] == ["1"]


def test_ranges_and_steps(spark):
    bad = one(spark, text.range_checks({"mcq_count": F.lit(151), "mcq_points": F.lit(0.75), "confidence": F.lit(0.5)}))[0]
    assert bad == ["mcq_count", "mcq_points"]
    assert one(spark, text.clamped_step(F.lit(4), 1, F.lit(5)), text.clamped_step(F.lit(0), -1, F.lit(5))) == (4, 0)
    assert one(spark, text.workspace_name(F.lit("My exam")), text.label_path(F.lit("a.b/c.d.png"))) == ("My_exam", "a.b/c.d.txt")


# --- images and sheets


def exif(orientation, order):
    n = lambda v, k: v.to_bytes(k, order)
    tiff = (b"II" if order == "little" else b"MM") + n(42, 2) + n(8, 4) + n(2, 2) + n(0x010F, 2) + n(2, 2) + n(1, 4) + n(0, 4) + n(0x0112, 2) + n(3, 2) + n(1, 4) + n(orientation, 2) + n(0, 2) + n(0, 4)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda\0\x02"


def test_orientations_are_read_and_undone():
    assert [images.exif_orientation(exif(k, order)) for order in ("little", "big") for k in range(10)] == 2 * [1, 1, 2, 3, 4, 5, 6, 7, 8, 1]
    assert images.exif_orientation(b"") == images.exif_orientation(b"\x89PNG....") == images.exif_orientation(b"\xff\xd8\xff\xda") == 1
    seen = np.arange(2 * 3 * 3).reshape(2, 3, 3)
    # how each orientation stores the picture: rows and columns of it
    stored = {1: seen, 2: seen[:, ::-1], 3: seen[::-1, ::-1], 4: seen[::-1], 5: seen.swapaxes(0, 1), 6: seen.swapaxes(0, 1)[::-1], 7: seen.swapaxes(0, 1)[::-1, ::-1], 8: seen.swapaxes(0, 1)[:, ::-1]}
    for k, pixels in stored.items():
        assert (images.upright(pixels, k) == seen).all(), k


def test_first_sheet_is_the_workbooks_first(tmp_path):
    content = workbook.build_sheet(["a"], iter([("x",)]))
    made = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(made, "w") as new:
        for name in old.namelist():
            said = old.read(name)
            if name == "xl/workbook.xml":
                said = said.replace(b'<sheet name="Sheet1" sheetId="1" r:id="r1"/>', b'<sheet name="First" sheetId="7" r:id="r2"/><sheet name="Sheet1" sheetId="1" r:id="r1"/>')
            if name == "xl/_rels/workbook.xml.rels":
                said = said.replace(b"</Relationships>", b'<Relationship Id="r2" Type="t" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
            new.writestr(name, said)
        new.writestr("xl/worksheets/sheet2.xml", old.read("xl/worksheets/sheet1.xml").replace(b'<c t="inlineStr"><is><t xml:space="preserve">x</t></is></c>', b'<c t="b"><v>1</v></c>'))
    assert workbook.parse_sheet(made.getvalue()) == [["a"], ["True"]]


def test_store_keeps_a_batch_that_runs_again_once(spark, tmp_path):
    shape = f"{submissions.GRADED}, {submissions.DETAILS}"
    rows = [(3, "s", "b", 2.0, "success", None, 2.0, 0.0, "[]"), (1, "s", "a", 1.0, "success", None, 1.0, 0.0, "[]"), (2, "s", "a", 1.0, "duplicate_id", 1.0, None, None, None)]
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        graded = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        submissions.run_to_store(graded, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
        for done in (tmp_path / "state" / "commits").iterdir():  # as if it had failed before the batch was noted down
            done.unlink()
    assert sorted((r.scan_id, r.student_id) for r in submissions.read_store(spark, str(tmp_path / "store")).collect()) == [(1, "a"), (2, "b")]
    assert len([x for x in os.listdir(tmp_path / "store") if x.startswith("upto=")]) == 1


def test_a_new_checkpoint_knows_stored_grades(spark, tmp_path):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sent = lambda seq, student, score: (seq, json.dumps({"session_id": "s", "student_id": student, "mcq_score": score, "essay_scores": [0.5], "total_score": score + 0.5, "mistakes": [{"q": 1, "student_ans": "A", "correct_ans": "B"}]}))
    registry = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "student_id string, student_name string")
    said = []
    with pytest.raises(ValueError):
        submissions.grade_stream_from(submissions.read_payloads(spark.readStream.schema("seq long, value string").parquet(str(tmp_path))), registry, submissions.read_store(spark, str(tmp_path / "none")))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", submissions.ROCKS)
    try:
        for turn, messages in enumerate([[sent(2, "a", 5.0), sent(1, "a", 7.0), sent(3, "b", 1.0), sent(4, "x", 1.0)], [sent(10, "a", 9.0), sent(11, "c", 3.0), sent(12, "c", 4.0)]]):
            folder = str(tmp_path / f"in{turn}")
            spark.createDataFrame(messages, "seq long, value string").write.parquet(folder)
            source = spark.readStream.schema("seq long, value string").parquet(folder)
            stored = submissions.read_store(spark, str(tmp_path / "store"))
            graded = submissions.grade_stream_from(submissions.read_payloads(source), registry, stored)
            submissions.run_to_files(graded, str(tmp_path / f"out{turn}"), str(tmp_path / f"answers{turn}")).awaitTermination()
            submissions.run_to_store(graded, str(tmp_path / "store"), str(tmp_path / f"state{turn}")).awaitTermination()
            said += [(r.seq, r.verdict, r.previous_score) for r in spark.read.parquet(str(tmp_path / f"out{turn}")).collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    assert sorted(said) == [(1, "success", None), (2, "duplicate_id", 7.5), (3, "success", None), (4, "id_not_found", None), (10, "duplicate_id", 7.5), (11, "success", None), (12, "duplicate_id", 3.5)]
    rows = sorted(tuple(r)[:6] for r in submissions.read_store(spark, str(tmp_path / "store")).collect())
    assert rows == [(1, "s", "a", 7.0, 0.5, 7.5), (2, "s", "b", 1.0, 0.5, 1.5), (3, "s", "c", 3.0, 0.5, 3.5)]
    assert {r.mistakes_log for r in submissions.read_store(spark, str(tmp_path / "store")).collect()} == {'[{"q":1,"student_ans":"A","correct_ans":"B"}]'}
