"""Queries over edited boxes, written label files, automatic labels, templates and small inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import autolabel, labels, roster
from ..sources import labels as files
from ..sources.paths import shared_folder
from . import fixtures as fx


def _boxes(spark, sf_dir):
    """A box for each vector, 25 to an image, numbered as drawn: the later vectors first."""
    image = F.floor(F.col("vec_id") / 25)
    return fx.label_boxes(spark, sf_dir).withColumns({"path": F.concat(F.lit("/images/"), (image % 3).cast("string"), F.lit("/"), image.cast("string"), F.lit(".png")), "seq": (-F.col("vec_id")).cast("bigint")})


def box_edits(spark, sf_dir):
    """Boxes reclassified, deleted and drawn anew, with their corners in pixels."""
    boxes = _boxes(spark, sf_dir).drop("path")
    drawn = boxes.filter("vec_id % 13 = 0").withColumns({"vec_id": F.col("vec_id") + 1_000_000, "class_id": F.lit(None).cast("int")})
    edited = labels.reclassify(boxes, F.col("vec_id") % 7 == 0, 9)
    edited = labels.insert_boxes(labels.delete_boxes(edited, boxes.filter("vec_id % 11 = 0"), ["vec_id"]), drawn, 2)
    corners = geometry.pixel_corners(*(F.col(c) for c in ("cx", "cy", "bw", "bh")), F.lit(640.0), F.lit(480.0))
    return edited.select("vec_id", "class_id", *(F.floor(c * 1000 + 0.5).cast("bigint").alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)))


def _written(spark, sf_dir, boxes):
    """Label files of all images under a new folder, as they are found there."""
    folder = shared_folder(spark)
    made = files.write_label_files(files.label_files(_boxes(spark, sf_dir).select("path").distinct(), boxes), folder=folder)
    made.write.format("noop").mode("overwrite").save()
    return folder


def label_round_trip(spark, sf_dir):
    """Label files written by the executors and read back: boxes in the order in which they were drawn."""
    folder = _written(spark, sf_dir, _boxes(spark, sf_dir))
    read = files.read_labels(spark, folder)
    share = [F.floor(F.col(c) * 1_000_000 + 0.5).cast("bigint").alias(c) for c in ("cx", "cy", "bw", "bh")]
    return read.select(F.regexp_extract("path", r"/(\d/\d+)\.txt$", 1).alias("name"), "seq", "class_id", *share)


def unlabelled_after_writing(spark, sf_dir):
    """Images that are still to be labelled: those without boxes have label files without bytes."""
    folder = _written(spark, sf_dir, _boxes(spark, sf_dir).filter("vec_id % 75 < 50"))
    images = _boxes(spark, sf_dir).select(F.concat(F.lit(f"file:{folder.removeprefix('file:')}"), "path").alias("path")).distinct()
    left = labels.unlabelled(images, files.list_label_files(spark, folder))
    return left.select(F.regexp_extract("path", r"/(\d/\d+)\.png$", 1).alias("name"))


def _photos(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    content = F.when(F.col("p_partkey") % 6 == 0, F.lit("bad")).otherwise((F.col("p_partkey") % 5).cast("string")).cast("binary")
    return p.select(F.concat(F.lit("/photos/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), content.alias("content"), "p_partkey", "p_size")


def _shade(content: bytes) -> np.ndarray | None:
    """The picture that a fixture's bytes stand for: 40 by 20 pixels of one shade."""
    return None if content == b"bad" else np.full((20, 40, 3), int(content) * 40, np.uint8)


def _stub():
    """A detector that finds one object, whose class is the shade, but nothing where it is black."""

    def run(tensor: np.ndarray) -> np.ndarray:
        shade = round(float(tensor[0, 0, 32, 32]) * 255 / 40)
        return np.array([[0, 0, 16, 64, 48, shade, 0.9 if shade else 0.1]], np.float32)

    return run


def auto_label_files(spark, sf_dir):
    """What a detector writes for photos without a filled label file."""
    photos = _photos(spark, sf_dir)
    done = photos.filter("p_partkey % 4 = 0").select(files.label_path(F.col("path")).alias("label_path"), (F.col("p_partkey") % 8).alias("length"))
    return autolabel.auto_label(photos.select("path", "content"), done, _stub, _shade, canvas=(64, 64))


def auto_label_metrics(spark, sf_dir):
    return labels.auto_label_counts(_photos(spark, sf_dir), F.col("content") != F.lit("bad").cast("binary"))


def template_sizes(spark, sf_dir):
    """Bytes of the templates cut out of turned photos; null where a photo is unreadable or nothing is left."""
    p = _photos(spark, sf_dir).withColumns({"turns": (F.col("p_partkey") % 4).cast("int"), "x": F.col("p_size").cast("int") - 12, "y": (F.col("p_partkey") % 25).cast("int"), "w": F.lit(15), "h": F.lit(9)})
    return autolabel.cut_templates(p, _shade, lambda a: a.tobytes()).select("path", F.length("template").alias("n_bytes"))


def class_list_round_trip(spark, sf_dir):
    """The class list written as a text file and read back."""
    path = shared_folder(spark)
    files.class_list_text(fx.class_names(spark, sf_dir)).coalesce(1).write.text(path)
    return files.read_class_names(spark, path)


def input_places(spark, sf_dir):
    """Places of essay fields, shares as percent, times of day and typed sizes."""
    o = fx.table(spark, sf_dir, "orders")
    row, col = roster.essay_grid(F.col("o_orderkey") % 20)
    share = (F.col("o_orderkey") % 200) / 200
    time = F.timestamp_seconds(F.col("o_orderkey") * 37)
    return o.select("o_orderkey", row.cast("int").alias("grid_row"), col.alias("grid_col"), text.percent(share).alias("percent"), text.clock(time).alias("clock"), labels.typed_size(F.col("o_orderkey") % 5 - 1.5).alias("typed"))


def input_ranges(spark, sf_dir):
    """Fields outside their ranges."""
    p = fx.table(spark, sf_dir, "part")
    bad = text.range_checks({"mcq_count": F.col("p_size") * 4, "mcq_points": F.col("p_size") / 4, "essay_count": F.col("p_size"), "confidence": F.col("p_size") / 50})
    return p.select("p_partkey", F.array_join(bad, ",").alias("bad"))


QUERIES = {f.__name__: f for f in (box_edits, label_round_trip, unlabelled_after_writing, auto_label_files, auto_label_metrics, template_sizes, class_list_round_trip, input_places, input_ranges)}
_PIXELS = ", ".join(f"CAST(floor(({e}) * 1000 + 0.5) AS BIGINT) AS {n}" for n, e in (("x1", "(cx - bw / 2) * 640.0::DOUBLE"), ("y1", "(cy - bh / 2) * 480.0::DOUBLE"), ("x2", "(cx + bw / 2) * 640.0::DOUBLE"), ("y2", "(cy + bh / 2) * 480.0::DOUBLE")))
_SHARES = ", ".join(f"CAST(floor(CAST(printf('%.6f', {c}) AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS {c}" for c in ("cx", "cy", "bw", "bh"))
ORACLE = {
    "box_edits": f"""WITH {fx.BOXES_SQL},
edited AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN 9 ELSE class_id END AS INTEGER) AS class_id, cx, cy, bw, bh FROM boxes WHERE vec_id % 11 <> 0
  UNION ALL SELECT vec_id + 1000000, CAST(2 AS INTEGER), cx, cy, bw, bh FROM boxes WHERE vec_id % 13 = 0)
SELECT vec_id, class_id, {_PIXELS} FROM edited""",
    "label_round_trip": f"""WITH {fx.BOXES_SQL} SELECT (vec_id // 25) % 3 || '/' || vec_id // 25 AS name,
CAST(row_number() OVER (PARTITION BY vec_id // 25 ORDER BY vec_id DESC) - 1 AS INTEGER) AS seq, class_id, {_SHARES} FROM boxes""",
    "unlabelled_after_writing": "SELECT DISTINCT (vec_id // 25) % 3 || '/' || vec_id // 25 AS name FROM embeddings WHERE vec_id % 75 >= 50",
    "auto_label_files": """SELECT '/photos/' || p_partkey || '.jpg' AS path,
CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_partkey % 5 || ' 0.487500 0.475000 0.975000 0.950000' END AS text
FROM part WHERE p_partkey % 6 <> 0 AND NOT (p_partkey % 4 = 0 AND p_partkey % 8 > 0)""",
    "auto_label_metrics": "SELECT count(*) AS attempted, count(*) FILTER (p_partkey % 6 <> 0) AS written FROM part",
    "template_sizes": """WITH t AS (SELECT p_partkey, p_size - 12 AS x, p_partkey % 25 AS y, CASE WHEN p_partkey % 2 = 0 THEN 40 ELSE 20 END AS pw, CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE 40 END AS ph FROM part),
s AS (SELECT p_partkey, greatest(0, least(pw, greatest(0, x + 15)) - greatest(0, x)) * greatest(0, least(ph, y + 9) - y) * 3 AS n FROM t)
SELECT '/photos/' || p_partkey || '.jpg' AS path, CAST(CASE WHEN p_partkey % 6 <> 0 AND n > 0 THEN n END AS INTEGER) AS n_bytes FROM s""",
    "class_list_round_trip": "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS class_id, r_name AS name FROM region",
    "input_places": """SELECT o_orderkey, CAST((o_orderkey % 20) // 3 AS INTEGER) AS grid_row, CAST((o_orderkey % 20) % 3 * 2 AS INTEGER) AS grid_col,
CAST(round_even((o_orderkey % 200) / 200 * 100, 0) AS INTEGER) AS percent, strftime(to_timestamp(o_orderkey * 37) AT TIME ZONE 'UTC', '%H:%M:%S') AS clock,
CAST(greatest(o_orderkey % 5 - 1.5, 1.0) AS DOUBLE) AS typed FROM orders""",
    "input_ranges": """SELECT p_partkey, concat_ws(',', CASE WHEN p_size * 4 NOT BETWEEN 1 AND 150 THEN 'mcq_count' END,
CASE WHEN p_size / 4 NOT BETWEEN 0.5 AND 100 OR p_size % 2 <> 0 THEN 'mcq_points' END, CASE WHEN p_size NOT BETWEEN 1 AND 20 THEN 'essay_count' END,
CASE WHEN p_size / 50 NOT BETWEEN 0.01 AND 0.99 THEN 'confidence' END) AS bad FROM part""",
}
