"""Decoding of detector outputs: both layouts, thresholds, suppression by class. All of it native expressions, but for crowded images."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import corners, letterbox, overlap, unletterbox
from ..functions.text import half_even

#: Score and overlap thresholds and canvas side unless given; row count below which an output counts as end-to-end; least side of a detection. Fixed values.
CONFIDENCE, OVERLAP, CANVAS, END_TO_END_ROWS, LEAST_SIDE = 0.25, 0.45, 640, 1000, 2.0


def is_end_to_end(rows: Column) -> Column:
    """Whether an image's output (an array of rows) is a list of final detections, by its shape."""
    width = F.size(F.get(rows, F.lit(0)))
    return F.coalesce(width.isin(6, 7) & (F.size(rows) < END_TO_END_ROWS), F.lit(False))


def split_layouts(outputs: DataFrame, layout: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Outputs (image_id, width, height, rows) that are end-to-end, and those that are raw grids; empty ones are in neither."""
    there = outputs.filter(F.size("rows") > 0)
    chosen = {"auto": is_end_to_end(F.col("rows")), "end_to_end": F.lit(True), "raw": F.lit(False)}[layout]
    return there.filter(chosen), there.filter(~chosen)


def exploded(outputs: DataFrame) -> DataFrame:
    """A row for each output row: image_id, width, height, anchor_id, v."""
    return outputs.select("image_id", "width", "height", F.posexplode("rows").alias("anchor_id", "v"))


def _placed(rows: DataFrame, canvas: tuple[int, int]) -> DataFrame:
    """Boxes x1..y2 of the canvas back on their images; those under the least side are dropped."""
    box = letterbox(F.col("width"), F.col("height"), *canvas)
    x = lambda c: unletterbox(F.col(c), box["left"], box["ratio"], F.col("width"))
    y = lambda c: unletterbox(F.col(c), box["top"], box["ratio"], F.col("height"))
    placed = rows.withColumns({"x1": x("x1"), "x2": x("x2"), "y1": y("y1"), "y2": y("y2")})
    return placed.filter((F.col("x2") - F.col("x1") >= LEAST_SIDE) & (F.col("y2") - F.col("y1") >= LEAST_SIDE))


def decode_end_to_end(rows: DataFrame, confidence: float = CONFIDENCE, canvas: tuple[int, int] = (CANVAS, CANVAS)) -> DataFrame:
    """Detections of rows (image_id, width, height, anchor_id, v) that are final: 7 fields with a batch number in front, or 6."""
    seven = F.size("v") == 7
    at = lambda a, b: F.when(seven, F.get("v", F.lit(a))).otherwise(F.get("v", F.lit(b))).cast("double")
    read = rows.select(
        "image_id", "width", "height", "anchor_id",
        at(1, 0).alias("x1"), at(2, 1).alias("y1"), at(3, 2).alias("x2"), at(4, 3).alias("y2"),
        half_even(at(5, 5)).alias("class_id"), at(6, 4).alias("score"),
    )
    kept = read.filter(F.col("score") >= confidence)
    return _placed(kept, canvas).select("image_id", "anchor_id", "x1", "y1", "x2", "y2", "class_id", "score")


def raw_candidates(rows: DataFrame, confidence: float = CONFIDENCE, n_classes: int | None = None) -> DataFrame:
    """Boxes on the canvas of raw grid rows that pass both thresholds (strictly), with their best class."""
    rows = rows.filter(F.get("v", F.lit(4)).cast("double") > confidence)
    scores = F.slice("v", 6, n_classes) if n_classes else F.slice("v", 6, F.greatest(F.size("v") - 5, F.lit(0)))
    rows = rows.withColumn("_scores", F.transform(scores, lambda x: x.cast("double"))).withColumn("_best", F.array_max("_scores"))
    rows = rows.withColumn("class_id", (F.array_position("_scores", F.col("_best")) - 1).cast("int")).withColumn("score", F.get("v", F.lit(4)).cast("double") * F.col("_best"))
    x1, y1, x2, y2 = corners(*(F.get("v", F.lit(i)).cast("double") for i in range(4)))
    return rows.filter(F.col("score") > confidence).select(*(c for c in rows.columns if c not in ("v", "_scores", "_best", "class_id", "score")), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "class_id", "score")


def suppress(candidates: DataFrame, iou: float = OVERLAP, canvas: tuple[int, int] = (CANVAS, CANVAS)) -> DataFrame:
    """The candidates that survive greedy suppression within image and class.

    Boxes are moved apart by class before they are compared. One shuffle on the image; the fold over an
    image's candidates, highest score first, is an expression that compares each with all that stay: for some
    thousands of candidates an image. `suppress_crowded` gives the same boxes in time that grows with the candidates.
    """
    shift = F.col("class_id") * float(max(canvas))
    fields = ["score", "anchor_id", "class_id", "x1", "y1", "x2", "y2"]
    moved = F.struct((-F.col("score")).alias("minus"), "anchor_id", "class_id", *((F.col(c) + shift).alias(c) for c in ("x1", "y1", "x2", "y2")))
    by_image = candidates.groupBy("image_id", "width", "height").agg(F.array_sort(F.collect_list(moved)).alias("c"))
    kind = "array<struct<minus:double,anchor_id:bigint,class_id:int,x1:double,y1:double,x2:double,y2:double>>"
    fold = F.aggregate(F.col("c").cast(kind), F.array().cast(kind), lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > iou), kept).otherwise(F.concat(kept, F.array(b))))
    kept = by_image.select("image_id", "width", "height", F.explode(fold).alias("k"))
    back = F.col("k.class_id") * float(max(canvas))
    return kept.select("image_id", "width", "height", F.col("k.anchor_id").alias("anchor_id"), F.col("k.class_id").alias("class_id"), (-F.col("k.minus")).alias("score"), *((F.col(f"k.{c}") - back).alias(c) for c in fields[3:]))


#: Corners beyond are no places.
FURTHEST = 1e150


class _Kept:
    """Boxes of one image that stay, found again by size and place.

    Two boxes overlap by more than `least` only if widths and heights each differ by less than that factor and their left upper corners lie
    within a box's side. So boxes are kept by the powers of two of their sides and by cells of that size, and a box is compared with those in
    few cells. Kept boxes of like size that share a cell are few, as they overlap by no more than `least` themselves.
    """

    #: What rounding may take from a ratio of sides.
    SLACK = 1 - 1e-9

    def __init__(self, least: float):
        self.least, self.levels = least, {}

    @staticmethod
    def _level(side: float) -> int:
        return max(math.frexp(side)[1], -500)

    def meets(self, box: tuple[float, ...]) -> bool:
        """Whether a kept box overlaps this one by more than `least`."""
        x1, y1, x2, y2 = box
        w, h = x2 - x1, y2 - y1
        ratio = self.least * self.SLACK
        low = lambda side: self._level(side * ratio) if side * ratio > 0 else -2000
        high = lambda side: self._level(side / ratio) if ratio and side / ratio < math.inf else 2000
        lw, hw, lh, hh = low(w), high(w), low(h), high(h)
        margin = 0 if self.least > 1e-6 else 1  # rounding decides only where any overlap counts
        for (a, b), (cells, everything) in self.levels.items():
            if not (lw <= a <= hw and lh <= b <= hh):
                continue
            side_x, side_y = 2.0**a, 2.0**b
            # a box of this level that meets ours begins at most its side before ours and not after ours ends
            left, right = math.floor((x1 - side_x) / side_x) - margin, math.floor(x2 / side_x) + margin
            top, bottom = math.floor((y1 - side_y) / side_y) - margin, math.floor(y2 / side_y) + margin
            if (right - left + 1) * (bottom - top + 1) > len(everything):
                near = everything
            else:
                near = (k for i in range(left, right + 1) for j in range(top, bottom + 1) for k in cells.get((i, j), ()))
            if any(self._overlap(k, box) > self.least for k in near):
                return True
        return False

    def add(self, box: tuple[float, ...]) -> None:
        x1, y1, x2, y2 = box
        at = self._level(x2 - x1), self._level(y2 - y1)
        cells, everything = self.levels.setdefault(at, ({}, []))
        cells.setdefault((math.floor(x1 / 2.0 ** at[0]), math.floor(y1 / 2.0 ** at[1])), []).append(box)
        everything.append(box)

    @staticmethod
    def _overlap(a: tuple[float, ...], b: tuple[float, ...]) -> float:
        """Intersection over union, rounded as `geometry.overlap` is."""
        shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
        return shared / union if union > 0 else 0.0


def suppress_crowded(candidates: DataFrame, iou: float = OVERLAP, canvas: tuple[int, int] = (CANVAS, CANVAS)) -> DataFrame:
    """As `suppress`, for images of any number of candidates.

    Boxes are moved apart by class before they are compared. One shuffle on the image, whose candidates Spark sorts; they pass by as a stream, of
    which the boxes that stay are held, in cells by size and place, so that time grows with the candidates and not with their pairs.
    Boxes without area, or with a corner or class that is null or a corner beyond FURTHEST, overlap none. Ties of the score go to the smaller anchor.
    """
    if not iou >= 0:
        raise ValueError("the overlap must not be negative")
    side = float(max(canvas))
    names = ["image_id", "width", "height", "anchor_id", "class_id", "score", "x1", "y1", "x2", "y2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, kept = object(), _Kept(iou)
        for batch in batches:
            columns = [batch.column(names.index(c)).to_pylist() for c in ("image_id", "class_id", "x1", "y1", "x2", "y2")]
            stay = []
            for i, (at, kind, *corners_) in enumerate(zip(*columns, strict=True)):
                if at != image:
                    image, kept = at, _Kept(iou)
                plain = kind is not None and all(c is not None and abs(c) < FURTHEST for c in corners_)
                box = tuple(c + kind * side for c in corners_) if plain else ()
                if box and box[0] < box[2] and box[1] < box[3]:
                    if kept.meets(box):
                        continue
                    kept.add(box)
                stay.append(i)
            yield batch.take(pa.array(stay, pa.int64()))

    rows = candidates.select(*names)
    ranked = rows.repartition("image_id").sortWithinPartitions("image_id", F.desc("score"), "anchor_id", "class_id", "x1", "y1", "x2", "y2")
    return ranked.mapInArrow(run, rows.schema)


def decode_raw(rows: DataFrame, confidence: float = CONFIDENCE, iou: float = OVERLAP, n_classes: int | None = None, canvas: tuple[int, int] = (CANVAS, CANVAS), crowded: bool = False) -> DataFrame:
    """Detections of raw grid rows (image_id, width, height, anchor_id, v)."""
    kept = (suppress_crowded if crowded else suppress)(raw_candidates(rows, confidence, n_classes), iou, canvas)
    return _placed(kept, canvas).select("image_id", "anchor_id", "x1", "y1", "x2", "y2", "class_id", "score")


def decode(outputs: DataFrame, confidence: float = CONFIDENCE, iou: float = OVERLAP, n_classes: int | None = None, layout: str = "auto", canvas: tuple[int, int] = (CANVAS, CANVAS), crowded: bool = False) -> DataFrame:
    """Detections of whole outputs (image_id, width, height, rows), each by its layout; `crowded` says how raw ones are suppressed, not which."""
    final, raw = split_layouts(outputs, layout)
    return decode_end_to_end(exploded(final), confidence, canvas).unionByName(decode_raw(exploded(raw), confidence, iou, n_classes, canvas, crowded))
