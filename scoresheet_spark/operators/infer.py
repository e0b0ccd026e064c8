"""Detector inference: the one place where a model runs, in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .detect import CANVAS

OUTPUT = "path string, width int, height int, rows array<array<float>>"


def onnx_runner(model: bytes | str) -> Callable[[np.ndarray], np.ndarray]:
    """Runs a model file on tensors; made once for each worker."""
    import onnxruntime

    session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda tensor: session.run(None, {name: tensor})[0]


def canvas_of(shape: list) -> tuple[int, int]:
    """Height and width of a model's input; dynamic sides count as CANVAS."""
    return tuple(d if isinstance(d, int) else CANVAS for d in shape[2:4])


def fit(image: np.ndarray, canvas: tuple[int, int], fill: int = 114) -> np.ndarray:
    """An image (height, width, 3) scaled into the canvas, bilinearly, with a border of grey."""
    h, w = image.shape[:2]
    ratio = min(canvas[0] / h, canvas[1] / w)
    new_h, new_w = max(1, round(h * ratio)), max(1, round(w * ratio))
    y = np.clip((np.arange(new_h) + 0.5) * h / new_h - 0.5, 0, h - 1)
    x = np.clip((np.arange(new_w) + 0.5) * w / new_w - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    source = image.astype(np.float32)
    scaled = (source[y0][:, x0] * (1 - fx) + source[y0][:, x1] * fx) * (1 - fy) + (source[y1][:, x0] * (1 - fx) + source[y1][:, x1] * fx) * fy
    out = np.full((*canvas, 3), fill, np.uint8)
    top, left = round((canvas[0] - new_h) / 2 - 0.1), round((canvas[1] - new_w) / 2 - 0.1)
    out[top : top + new_h, left : left + new_w] = np.rint(scaled).astype(np.uint8)
    return out


def tensor(image: np.ndarray) -> np.ndarray:
    """Blue-green-red bytes as a batch of one red-green-blue float tensor in 0..1."""
    return np.ascontiguousarray(image[:, :, ::-1].transpose(2, 0, 1), np.float32)[None] / np.float32(255)


def rows_of(output: np.ndarray) -> np.ndarray:
    """A model's output as a matrix of rows: axes of length 1 go, one row stays a row, nothing is no row."""
    out = np.squeeze(np.asarray(output, np.float32))
    return np.atleast_2d(out) if out.size else np.zeros((0, 0), np.float32)


#: Numbers of output that one batch holds, about.
MOST_NUMBERS = 4_000_000


def _batch(paths: list[str], sizes: list[tuple[int, int] | None], outputs: list[np.ndarray]) -> pa.RecordBatch:
    """A batch of OUTPUT out of matrices, without Python numbers; images without a size have null fields."""
    there = np.array([s is not None for s in sizes])
    counts = np.array([m.shape[0] for m in outputs], np.int64)
    widths = np.repeat([m.shape[1] for m in outputs], counts)
    flat = np.concatenate([m.ravel() for m in outputs]) if outputs else np.zeros(0, np.float32)
    ends = lambda x: pa.array(np.r_[0, np.cumsum(x)].astype(np.int32))
    inner = pa.ListArray.from_arrays(ends(widths), pa.array(flat, pa.float32()))
    rows = pa.ListArray.from_arrays(ends(counts), inner, mask=pa.array(~there))
    side = lambda i: pa.array([None if s is None else s[i] for s in sizes], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), side(0), side(1), rows], names=["path", "width", "height", "rows"])


def infer(images: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], read: Callable[[bytes], np.ndarray | None], canvas: tuple[int, int] = (CANVAS, CANVAS)) -> DataFrame:
    """(path, width, height, rows) of images (path, content): what `detect.decode` takes.

    `load` makes the model's run function in each worker; `read` turns bytes into an image, None if it can't:
    such images have null width, height and rows. Results leave in batches of about MOST_NUMBERS numbers.
    Images are dealt by their path to the session's shuffle partitions first: a table of few bytes is one partition, whose model would run alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            paths, sizes, outputs, held = [], [], [], 0
            for i in range(batch.num_rows):  # one image's bytes at a time
                image = read(batch.column(1)[i].as_py())
                paths.append(batch.column(0)[i].as_py())
                sizes.append(None if image is None else (image.shape[1], image.shape[0]))
                outputs.append(np.zeros((0, 0), np.float32) if image is None else rows_of(model(tensor(fit(image, canvas)))))
                held += outputs[-1].size
                if held >= MOST_NUMBERS:
                    yield _batch(paths, sizes, outputs)
                    paths, sizes, outputs, held = [], [], [], 0
            if paths:
                yield _batch(paths, sizes, outputs)

    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return images.select("path", "content").repartition(parts, "path").mapInArrow(run, OUTPUT)
