"""Geometry of boxes and canvases as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clip, half_even, truncated


def letterbox(width: Column, height: Column, canvas_w: float, canvas_h: float) -> dict[str, Column]:
    """Scale, resized size and padding that fit an image into a canvas."""
    ratio = F.least(F.lit(float(canvas_h)) / height, F.lit(float(canvas_w)) / width)
    new_w, new_h = half_even(width * ratio), half_even(height * ratio)
    free_w, free_h = (F.lit(float(canvas_w)) - new_w) / 2, (F.lit(float(canvas_h)) - new_h) / 2
    return {
        "ratio": ratio,
        "new_w": new_w,
        "new_h": new_h,
        "left": half_even(free_w - 0.1),
        "right": half_even(free_w + 0.1),
        "top": half_even(free_h - 0.1),
        "bottom": half_even(free_h + 0.1),
    }


def unletterbox(edge: Column, pad: Column, ratio: Column, size: Column) -> Column:
    """A canvas coordinate back on the image, within 0..size - 1."""
    return clip((edge - pad) / ratio, F.lit(0.0), size - 1.0)


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def normalised_centre(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the image."""
    return (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height


def pixel_corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Corners in pixels of a box whose centre and size are shares of the image."""
    return tuple(c * side for c, side in zip(corners(cx, cy, w, h), (width, height, width, height), strict=True))


def upright(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """The same rectangle with width and height that aren't negative."""
    return F.least(x, x + w), F.least(y, y + h), F.abs(w), F.abs(h)


def moved(x: Column, y: Column, dx: Column | float, dy: Column | float) -> tuple[Column, Column]:
    """The same rectangle elsewhere: nudged by keys or dragged."""
    return x + dx, y + dy


def moved_edges(x: Column, y: Column, w: Column, h: Column, edges: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column, Column]:
    """The rectangle with the edges named in `edges` (letters out of l, r, t, b) moved, then made upright."""
    has = lambda e: F.contains(edges, F.lit(e))
    x1 = F.when(has("l"), x + dx).otherwise(x)
    y1 = F.when(has("t"), y + dy).otherwise(y)
    x2 = F.when(has("r"), x + w + dx).otherwise(x + w)
    y2 = F.when(has("b"), y + h + dy).otherwise(y + h)
    return upright(x1, y1, x2 - x1, y2 - y1)


def near_edges(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column, reach: float = 7.0) -> Column:
    """Letters of the edges closer to the point than `reach`."""
    hits = [F.when(F.abs(px - x) < reach, "l"), F.when(F.abs(px - x - w) < reach, "r"), F.when(F.abs(py - y) < reach, "t"), F.when(F.abs(py - y - h) < reach, "b")]
    return F.concat_ws("", *hits)


def roi(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A region of interest as integers, toward zero; null where it has no area."""
    cut = F.struct(*(truncated(c).alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))
    return F.when((cut["w"] > 0) & (cut["h"] > 0), cut)


def quarter_turns(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, turns: Column) -> tuple[Column, ...]:
    """The rectangle and its canvas size after clockwise quarter turns."""
    t = F.pmod(turns, F.lit(4))
    pick = lambda *v: F.when(t == 0, v[0]).when(t == 1, v[1]).when(t == 2, v[2]).otherwise(v[3])
    return (
        pick(x, height - y - h, width - x - w, y),
        pick(y, x, height - y - h, width - x - w),
        pick(w, h, w, h),
        pick(h, w, h, w),
        pick(width, height, width, height),
        pick(height, width, height, width),
    )


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x1, y1, x2, y2."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))
