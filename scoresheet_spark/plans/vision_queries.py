"""Queries over images, labels and detector outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import clamped_step
from ..operators import detect, labels
from ..operators.positions import ordinals
from ..sources import labels as files
from . import fixtures as fx


def class_names(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("class_id"))
    return labels.named(e, fx.class_names(spark, sf_dir)).select("vec_id", "class_id", "class_name", labels.shortcut(F.col("class_id")).alias("key"))


def class_append(spark, sf_dir):
    names = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), F.when(F.col("n_nationkey") < 3, "ASIA").when(F.col("n_nationkey") < 5, "  ").otherwise(F.concat(F.lit(" "), "n_name")).alias("name"))
    return labels.append_classes(fx.class_names(spark, sf_dir), names)


def class_delete(spark, sf_dir):
    return labels.delete_class(fx.class_names(spark, sf_dir), 2)


def _images(spark, sf_dir):
    return files.catalogue(fx.image_paths(spark, sf_dir))


def image_catalogue(spark, sf_dir):
    return _images(spark, sf_dir)


def unlabelled_images(spark, sf_dir):
    """Images of documents without a label; toxic ones have a label file without bytes."""
    images = fx.image_paths(spark, sf_dir)
    said = fx.table(spark, sf_dir, "labels").join(images, "doc_id").select(files.label_path(F.col("path")).alias("label_path"), F.when(F.col("toxic") == 1, 0).otherwise(20).alias("length"))
    return labels.unlabelled(_images(spark, sf_dir), said).select("path")


def annotations_per_image(spark, sf_dir):
    """Quality labels of each image as its boxes."""
    images = fx.image_paths(spark, sf_dir)
    boxes = fx.table(spark, sf_dir, "labels").join(images, "doc_id").select("path")
    return labels.annotation_counts(_images(spark, sf_dir), boxes)


def label_format(spark, sf_dir):
    return files.format_label(fx.label_boxes(spark, sf_dir)).select("vec_id", "line")


def label_parse(spark, sf_dir):
    """Formatted lines with tabs and a further field, and short ones, read back."""
    lines = files.format_label(fx.label_boxes(spark, sf_dir)).select(
        F.col("vec_id").alias("path"),
        F.when(F.col("class_id") == 3, "3 0.5 0.5").otherwise(F.concat(F.lit(" \t"), F.replace("line", F.lit(" "), F.lit(" \t ")), F.lit(" extra\t"))).alias("value"),
    )
    return files.parse_label_lines(lines)


def label_file_text(spark, sf_dir):
    """The label files of all vectors' images, 25 boxes each."""
    boxes = fx.label_boxes(spark, sf_dir).withColumn("path", F.concat(F.lit("image-"), F.floor(F.col("vec_id") / 25).cast("string")))
    return files.label_files(boxes.select("path").distinct(), boxes)


def letterbox_params(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_size") * 31).alias("w"), (60 + F.floor("p_retailprice")).cast("int").alias("h"))
    return p.select("p_partkey", *(c.alias(n) for n, c in geometry.letterbox(F.col("w"), F.col("h"), 640, 640).items()))


def _rects(spark, sf_dir):
    """Rectangles out of line items, some with negative sides."""
    side = lambda c, flag: F.when(F.col("l_returnflag") == flag, -F.col(c)).otherwise(F.col(c))
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 100).alias("x"), (F.col("l_partkey") / 4.0).cast("double").alias("y"), side("l_quantity", "A").alias("w"), side("l_quantity", "R").alias("h")
    )


def roi_truncate(spark, sf_dir):
    r = _rects(spark, sf_dir)
    box = geometry.upright(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geometry.roi(*box).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.*")


def roi_rotate(spark, sf_dir):
    r = _rects(spark, sf_dir)
    box = geometry.upright(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    turned = geometry.quarter_turns(*box, F.lit(3000.0), F.lit(2000.0), F.col("l_linenumber"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(n) for c, n in zip(turned, ("x", "y", "w", "h", "canvas_w", "canvas_h"), strict=True)))


def rect_edit(spark, sf_dir):
    """Each rectangle made upright, moved, pulled at its right lower corner, and tested for nearness to a point."""
    r = _rects(spark, sf_dir)
    x, y, w, h = geometry.upright(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    pulled = geometry.moved_edges(x + 10, y - 1, w, h, F.lit("rb"), F.lit(-20.0), F.lit(4.0))
    near = geometry.near_edges(F.lit(500.0), F.lit(100.0), *pulled)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(n) for c, n in zip(pulled, ("x", "y", "w", "h"), strict=True)), near.alias("near"), labels.drawn_large_enough(pulled[2], pulled[3]).alias("kept"))


def _thousandths(df):
    return df.select("image_id", "anchor_id", "class_id", *(F.floor(F.col(c) * 1000 + 0.5).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2", "score")))


def decode_end2end(spark, sf_dir):
    return _thousandths(detect.decode_end_to_end(fx.final_rows(spark, sf_dir, 7)))


def decode_end2end_six(spark, sf_dir):
    return _thousandths(detect.decode_end_to_end(fx.final_rows(spark, sf_dir, 6)))


def decode_raw_candidates(spark, sf_dir):
    return _thousandths(detect.raw_candidates(fx.raw_grid(spark, sf_dir)))


def nms_kept(spark, sf_dir):
    return detect.suppress(detect.raw_candidates(fx.raw_grid(spark, sf_dir))).select("image_id", "anchor_id", "class_id")


def nms_crowded(spark, sf_dir):
    """Suppression by cells of size and place: the survivors of `nms_kept`."""
    return detect.suppress_crowded(detect.raw_candidates(fx.raw_grid(spark, sf_dir))).select("image_id", "anchor_id", "class_id")


def decode_layouts(spark, sf_dir):
    """Whole outputs of both layouts through the dispatcher: detections of each image."""
    final = fx.final_rows(spark, sf_dir, 7).groupBy((-F.col("image_id") - 1).alias("image_id"), "width", "height").agg(F.array_sort(F.collect_list(F.struct(F.col("anchor_id").cast("bigint").alias("anchor_id"), "v"))).alias("r"))
    raw = fx.raw_grid(spark, sf_dir).groupBy("image_id", "width", "height").agg(F.array_sort(F.collect_list(F.struct("anchor_id", "v"))).alias("r"))
    outputs = final.unionByName(raw).select("image_id", "width", "height", F.transform("r", lambda x: x["v"]).alias("rows"))
    return detect.decode(outputs).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("lowest_class"))


def nav_ordinals(spark, sf_dir):
    d = ordinals(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return d.select("doc_id", "ordinal", "total", clamped_step(F.col("ordinal") - 1, 1, F.col("total")).alias("next"), clamped_step(F.col("ordinal") - 1, -1, F.col("total")).alias("previous"))


QUERIES = {
    f.__name__: f
    for f in (
        class_names, class_append, class_delete, image_catalogue, unlabelled_images, annotations_per_image, label_format, label_parse, label_file_text, letterbox_params,
        roi_truncate, roi_rotate, rect_edit, decode_end2end, decode_end2end_six, decode_raw_candidates, nms_kept, nms_crowded, decode_layouts, nav_ordinals,
    )
}

_IMAGES_SQL = f"{fx.PATHS_SQL}, images AS (SELECT doc_id, path, string_split(path, '/')[-1] AS name, regexp_replace(path, '\\.[^./]*$', '') || '.txt' AS label_path FROM paths WHERE NOT ends_with(path, '.gif'))"
_RECT_SQL = """rects AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 100 AS x0, CAST(l_partkey AS DOUBLE) / 4 AS y0,
  CASE WHEN l_returnflag = 'A' THEN -l_quantity ELSE l_quantity END AS w0, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS h0 FROM lineitem),
upright AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(x0, x0 + w0) AS x, least(y0, y0 + h0) AS y, abs(w0) AS w, abs(h0) AS h FROM rects)"""
_MILLI = ", ".join(f"CAST(floor({c} * 1000 + 0.5) AS BIGINT) AS {c}" for c in ("x1", "y1", "x2", "y2", "score"))


def _placed_sql(source: str, width: int, height: int) -> str:
    ratio, left, top = (0.8, 0, 80) if (width, height) == (800, 600) else (1.0, 0, 0)
    x = lambda c: f"greatest(0.0, least(({c} - {left}) / CAST({ratio} AS DOUBLE), {width} - 1.0)) AS {c}"
    y = lambda c: f"greatest(0.0, least(({c} - {top}) / CAST({ratio} AS DOUBLE), {height} - 1.0)) AS {c}"
    return f"SELECT image_id, anchor_id, class_id, {x('x1')}, {y('y1')}, {x('x2')}, {y('y2')}, score FROM {source}"


def _final_sql(width: int) -> str:
    return f"final AS ({fx.final_sql(width)}), placed AS ({_placed_sql('(SELECT * FROM final WHERE score >= 0.25)', 800, 600)})"


_NMS_SQL = f"""{fx.GRID_SQL},
ranked AS (SELECT *, x1 + class_id * 640.0 AS a1, y1 + class_id * 640.0 AS b1, x2 + class_id * 640.0 AS a2, y2 + class_id * 640.0 AS b2,
  row_number() OVER (PARTITION BY image_id ORDER BY score DESC, anchor_id) AS rk FROM candidates),
clashes AS (SELECT b.image_id, b.rk, list(a.rk) AS over_ FROM ranked a JOIN ranked b ON a.image_id = b.image_id AND a.rk < b.rk
  WHERE greatest(0.0, least(a.a2, b.a2) - greatest(a.a1, b.a1)) * greatest(0.0, least(a.b2, b.b2) - greatest(a.b1, b.b1)) /
    ((a.a2 - a.a1) * (a.b2 - a.b1) + (b.a2 - b.a1) * (b.b2 - b.b1) - greatest(0.0, least(a.a2, b.a2) - greatest(a.a1, b.a1)) * greatest(0.0, least(a.b2, b.b2) - greatest(a.b1, b.b1))) > 0.45
  GROUP BY ALL),
steps(image_id, rk, kept) AS (
  SELECT image_id, rk, [rk] FROM ranked WHERE rk = 1
  UNION ALL
  SELECT s.image_id, r.rk, CASE WHEN list_has_any(s.kept, coalesce(c.over_, [])) THEN s.kept ELSE list_append(s.kept, r.rk) END
  FROM steps s JOIN ranked r ON r.image_id = s.image_id AND r.rk = s.rk + 1 LEFT JOIN clashes c ON c.image_id = r.image_id AND c.rk = r.rk),
last_ AS (SELECT image_id, unnest(arg_max(kept, rk)) AS rk FROM steps GROUP BY image_id),
survivors AS (SELECT r.* FROM ranked r JOIN last_ USING (image_id, rk))"""
ORACLE = {
    "class_names": "SELECT vec_id, CAST(label AS INTEGER) AS class_id, coalesce(r_name, 'cls' || label) AS class_name, CAST(CASE WHEN label < 9 THEN label + 1 END AS INTEGER) AS key FROM embeddings LEFT JOIN region ON r_regionkey = label",
    "class_append": """WITH fresh AS (SELECT n_nationkey AS seq, trim(CASE WHEN n_nationkey < 3 THEN 'ASIA' WHEN n_nationkey < 5 THEN '  ' ELSE n_name END) AS name FROM nation)
SELECT CAST(r_regionkey AS INTEGER) AS class_id, r_name AS name FROM region
UNION ALL SELECT CAST((SELECT max(r_regionkey) + 1 FROM region) + row_number() OVER (ORDER BY min(seq)) - 1 AS INTEGER), name FROM fresh WHERE name <> '' AND name NOT IN (SELECT r_name FROM region) GROUP BY name""",
    "class_delete": "SELECT CAST(r_regionkey - (CASE WHEN r_regionkey > 2 THEN 1 ELSE 0 END) AS INTEGER) AS class_id, r_name AS name FROM region WHERE r_regionkey <> 2",
    "image_catalogue": f"WITH {_IMAGES_SQL} SELECT path, name, label_path FROM images",
    "unlabelled_images": f"WITH {_IMAGES_SQL} SELECT path FROM images WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic <> 1 AND doc_id IS NOT NULL)",
    "annotations_per_image": f"WITH {_IMAGES_SQL} SELECT path, (SELECT count(*) FROM labels WHERE labels.doc_id = images.doc_id) AS n_boxes FROM images",
    "label_format": f"WITH {fx.BOXES_SQL} SELECT vec_id, class_id || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', cy) || ' ' || printf('%.6f', bw) || ' ' || printf('%.6f', bh) AS line FROM boxes",
    "label_parse": f"WITH {fx.BOXES_SQL} SELECT vec_id AS path, class_id, {', '.join(f'CAST(printf({chr(39)}%.6f{chr(39)}, {c}) AS DOUBLE) AS {c}' for c in ('cx', 'cy', 'bw', 'bh'))} FROM boxes WHERE class_id <> 3",
    "label_file_text": f"""WITH {fx.BOXES_SQL}, lines AS (SELECT 'image-' || CAST(vec_id // 25 AS VARCHAR) AS path, class_id || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', cy) || ' ' || printf('%.6f', bw) || ' ' || printf('%.6f', bh) AS line FROM boxes)
SELECT path, string_agg(line, chr(10) ORDER BY line) AS text FROM lines GROUP BY path""",
    "letterbox_params": """WITH sizes AS (SELECT p_partkey, 100 + p_size * 31 AS w, CAST(60 + floor(p_retailprice) AS INTEGER) AS h FROM part),
scaled AS (SELECT *, least(640.0::DOUBLE / h, 640.0::DOUBLE / w) AS ratio FROM sizes),
fitted AS (SELECT *, CAST(round_even(w * ratio, 0) AS INTEGER) AS new_w, CAST(round_even(h * ratio, 0) AS INTEGER) AS new_h FROM scaled)
SELECT p_partkey, ratio, new_w, new_h, CAST(round_even((640.0::DOUBLE - new_w) / 2 - 0.1::DOUBLE, 0) AS INTEGER) AS "left", CAST(round_even((640.0::DOUBLE - new_w) / 2 + 0.1::DOUBLE, 0) AS INTEGER) AS "right",
CAST(round_even((640.0::DOUBLE - new_h) / 2 - 0.1::DOUBLE, 0) AS INTEGER) AS top, CAST(round_even((640.0::DOUBLE - new_h) / 2 + 0.1::DOUBLE, 0) AS INTEGER) AS bottom FROM fitted""",
    "roi_truncate": f"""WITH {_RECT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"CASE WHEN trunc(w) > 0 AND trunc(h) > 0 THEN CAST(trunc({c}) AS INTEGER) END AS {c}" for c in "xywh")} FROM upright""",
    "roi_rotate": f"""WITH {_RECT_SQL}, t AS (SELECT *, l_linenumber % 4 AS q FROM upright) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
CASE q WHEN 0 THEN x WHEN 1 THEN 2000.0 - y - h WHEN 2 THEN 3000.0 - x - w ELSE y END AS x, CASE q WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 2000.0 - y - h ELSE 3000.0 - x - w END AS y,
CASE WHEN q % 2 = 0 THEN w ELSE h END AS w, CASE WHEN q % 2 = 0 THEN h ELSE w END AS h,
CAST(CASE WHEN q % 2 = 0 THEN 3000 ELSE 2000 END AS DOUBLE) AS canvas_w, CAST(CASE WHEN q % 2 = 0 THEN 2000 ELSE 3000 END AS DOUBLE) AS canvas_h FROM t""",
    "rect_edit": f"""WITH {_RECT_SQL}, moved AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x + 10 AS a, y - 1 AS b, x + 10 + w + -20.0 - (x + 10) AS dw, y - 1 + h + 4.0 - (y - 1) AS dh FROM upright),
final AS (SELECT *, least(a, a + dw) AS x, least(b, b + dh) AS y, abs(dw) AS w, abs(dh) AS h FROM moved)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, w, h,
(CASE WHEN abs(500.0 - x) < 7 THEN 'l' ELSE '' END) || (CASE WHEN abs(500.0 - x - w) < 7 THEN 'r' ELSE '' END) || (CASE WHEN abs(100.0 - y) < 7 THEN 't' ELSE '' END) || (CASE WHEN abs(100.0 - y - h) < 7 THEN 'b' ELSE '' END) AS near,
w > 4 AND h > 4 AS kept FROM final""",
    "decode_end2end": f"WITH {_final_sql(7)} SELECT image_id, anchor_id, class_id, {_MILLI} FROM placed WHERE x2 - x1 >= 2 AND y2 - y1 >= 2",
    "decode_end2end_six": f"WITH {_final_sql(6)} SELECT image_id, anchor_id, class_id, {_MILLI} FROM placed WHERE x2 - x1 >= 2 AND y2 - y1 >= 2",
    "decode_raw_candidates": f"WITH {fx.GRID_SQL} SELECT image_id, anchor_id, class_id, {_MILLI} FROM candidates",
    "nms_kept": f"WITH RECURSIVE {_NMS_SQL} SELECT image_id, anchor_id, class_id FROM survivors",
    "decode_layouts": f"""WITH RECURSIVE {_NMS_SQL}, {_final_sql(7)}, both_ AS (
SELECT -image_id - 1 AS image_id, class_id, x1, y1, x2, y2 FROM placed UNION ALL SELECT image_id, class_id, x1, y1, x2, y2 FROM ({_placed_sql('survivors', 640, 640)}))
SELECT image_id, count(*) AS n, min(class_id) AS lowest_class FROM both_ WHERE x2 - x1 >= 2 AND y2 - y1 >= 2 GROUP BY image_id""",
    "nav_ordinals": """SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal, count(*) OVER () AS total,
least(row_number() OVER (ORDER BY doc_id), count(*) OVER () - 1) AS next, greatest(row_number() OVER (ORDER BY doc_id) - 2, 0) AS previous FROM documents""",
}
ORACLE["nms_crowded"] = ORACLE["nms_kept"]
