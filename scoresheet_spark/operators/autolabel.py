"""Label files from a detector, and templates cut out of photos."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalised_centre
from ..sources.labels import label_files
from ..sources.paths import settled
from . import detect, infer
from .labels import unlabelled


def detections_as_boxes(detections: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, class_id, cx, cy, bw, bh) of detections, whose image_id is a path, and sizes (path, width, height)."""
    named = detections.withColumnRenamed("image_id", "path").join(sizes, "path")
    cx, cy, bw, bh = normalised_centre(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("width"), F.col("height"))
    return named.select("path", "class_id", cx.alias("cx"), cy.alias("cy"), bw.alias("bw"), bh.alias("bh"))


def auto_label(
    images: DataFrame,
    labels: DataFrame,
    load: Callable[[], Callable[[np.ndarray], np.ndarray]],
    read: Callable[[bytes], np.ndarray | None],
    remaining_only: bool = True,
    n_classes: int | None = None,
    confidence: float = detect.CONFIDENCE,
    iou: float = detect.OVERLAP,
    canvas: tuple[int, int] = (detect.CANVAS, detect.CANVAS),
) -> DataFrame:
    """(path, text) of the label files that a detector makes for images (path, content).

    The model runs once for each image. With `remaining_only` just images without a filled label file are looked at; images without detections
    get an empty file, unreadable ones none.
    """
    chosen = unlabelled(images, labels) if remaining_only else images
    outputs = settled(infer.infer(chosen, load, read, canvas))  # the model sees each image once; sizes, both layouts and files read what it said
    readable = outputs.filter(F.col("width").isNotNull())
    found = detect.decode(readable.withColumnRenamed("path", "image_id"), confidence, iou, n_classes, canvas=canvas)
    return label_files(readable.select("path"), detections_as_boxes(found, readable.select("path", "width", "height")))


#: Bytes of encoded templates in one batch, about.
MOST_BYTES = 16_000_000


def cut_templates(photos: DataFrame, read: Callable[[bytes], np.ndarray | None], encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(path, template) of photos (path, content, turns, x, y, w, h): turned clockwise by quarter turns, cut to the region, encoded.

    The region refers to the turned photo and is clipped to it; one without area gives null, like an unreadable photo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, made, held = [], [], 0
            for i in range(batch.num_rows):
                path, content, turns, x, y, w, h = (c[i].as_py() for c in batch.columns)
                image, part = read(content), np.zeros(0)
                if image is not None:
                    image = np.rot90(image, -int(turns))
                    part = image[max(0, int(y)) : max(0, int(y) + int(h)), max(0, int(x)) : max(0, int(x) + int(w))]
                paths.append(path)
                made.append(encode(np.ascontiguousarray(part)) if part.size else None)
                held += len(made[-1] or b"")
                if held >= MOST_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], names=["path", "template"])
                    paths, made, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], names=["path", "template"])

    return photos.select("path", "content", "turns", "x", "y", "w", "h").mapInArrow(run, "path string, template binary")
