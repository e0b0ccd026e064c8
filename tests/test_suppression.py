"""Suppression by cells against the definition, and its cost on crowded images."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scoresheet_spark.operators import detect

KIND = "image_id string, width int, height int, anchor_id bigint, class_id int, score double, x1 double, y1 double, x2 double, y2 double"


def share(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def greedy(rows, iou):
    """Every box against every kept box of its image."""
    kept, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0], -r[5], r[3])):
        box = tuple(c + r[4] * 640.0 for c in r[6:])
        if not any(share(k, box) > iou for k in kept.get(r[0], [])):
            kept.setdefault(r[0], []).append(box)
            out.append((r[0], r[3]))
    return sorted(out)


def crowd(seed, n):
    """Boxes of very unlike sizes, many of them moved copies, some without area, turned round or far outside."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        w, h = 2 ** rng.uniform(-3, 9), 2 ** rng.uniform(-3, 9)
        x, y = rng.uniform(-300, 900), rng.uniform(-300, 900)
        if rows and rng.random() < 0.6:
            x, y, x2, y2 = rng.choice(rows)[6:]
            w, h = x2 - x, y2 - y
            x, y, w, h = x + w * rng.uniform(-0.5, 0.5), y + h * rng.uniform(-0.5, 0.5), w * rng.uniform(0.5, 2), h * rng.uniform(0.5, 2)
        if rng.random() < 0.05:
            w = rng.choice([0.0, -w, 64.0])
        rows.append((f"i{rng.randrange(3)}", 640, 640, i, rng.randrange(3), rng.choice([0.5, rng.random()]), x, y, x + w, y + h))
    return rows


@pytest.mark.parametrize("iou", [0.0, 0.001, 0.1, 0.45, 0.5, 0.9, 1.0])
def test_survivors_are_those_of_all_comparisons(spark, iou):
    rows = crowd(int(iou * 1000), 700)
    found = detect.suppress_crowded(spark.createDataFrame(rows, KIND).repartition(5), iou)
    assert sorted((r.image_id, r.anchor_id) for r in found.collect()) == greedy(rows, iou)


def test_both_ways_decode_the_same(spark):
    rows = spark.range(400).select(
        (F.col("id") % 3).alias("image_id"), F.lit(800).alias("width"), F.lit(600).alias("height"), F.col("id").alias("anchor_id"),
        F.array(*(300 + 90 * F.rand(i) for i in (1, 2)), *(40 + 60 * F.rand(i) for i in (3, 4)), *(0.3 + 0.7 * F.rand(i) for i in (5, 6, 7))).alias("v"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    native, crowded = ({tuple(r)[:2] for r in detect.decode_raw(rows, crowded=c).collect()} for c in (False, True))
    assert native == crowded and 3 < len(native) < 400


def test_boxes_that_are_no_places_stay_and_hide_nothing(spark):
    odd = [(None, None), (float("nan"), 1.0), (float("inf"), 1.0), (1e200, 1.0), (5.0, 5.0)]
    rows = [(None, 640, 640, i, 0, 0.9, 0.0, 0.0, x, y) for i, (x, y) in enumerate(odd)] + [(None, 640, 640, 9, None, 0.5, 0.0, 0.0, 5.0, 5.0), (None, 640, 640, 10, 0, 0.4, 0.0, 0.0, 5.0, 5.0)]
    rows += [(None, 640, 640, 11, 0, 0.3, 600.0, 600.0, 600.0000001, 601.0), (None, 640, 640, 12, 0, 0.3, 0.0, 0.0, 1e-320, 1e-320)]
    found = detect.suppress_crowded(spark.createDataFrame(rows, KIND), 0.0)
    assert sorted(r.anchor_id for r in found.collect()) == [0, 1, 2, 3, 4, 9, 11, 12]  # the area that 12 shares is too small for a double
    assert detect.suppress_crowded(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(ValueError):
        detect.suppress_crowded(spark.createDataFrame([], KIND), -0.1)


@pytest.mark.parametrize("spread", [40, 40_000])
def test_time_grows_with_the_boxes_not_with_their_pairs(spark, spread):
    """One image of 100,000 boxes, in a heap or side by side."""

    def seconds(n):
        at = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(spread * 10)) / 10.0
        rows = spark.range(n).select(
            F.lit("one").alias("image_id"), F.lit(640).alias("width"), F.lit(640).alias("height"), F.col("id").alias("anchor_id"), F.lit(0).alias("class_id"), F.rand(3).alias("score"),
            at(1).alias("x1"), at(2).alias("y1"), (at(1) + 20).alias("x2"), (at(2) + 30).alias("y2"),
        )
        began = time.monotonic()
        kept = detect.suppress_crowded(rows).count()
        return time.monotonic() - began, kept

    seconds(1000)
    (small, _), (large, kept) = seconds(25_000), seconds(100_000)
    assert 1 < kept < 100_000 and large < 60 and large < 8 * max(small, 1.0)
    print(f"{spread}: 25,000 boxes {small:.1f} s, 100,000 boxes {large:.1f} s, {kept} stay")
