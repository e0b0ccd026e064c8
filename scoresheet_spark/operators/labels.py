"""Annotations of images: class names, boxes, what is still to be labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank, strip
from ..sources.labels import label_path
from .grading import numbered


def named(rows: DataFrame, classes: DataFrame, class_id: str = "class_id") -> DataFrame:
    """`rows` with class_name; ids without a name read cls<id>."""
    names = classes.select(F.col("class_id").alias(class_id), F.col("name").alias("_name"))
    return rows.join(names, class_id, "left").withColumn("class_name", F.coalesce("_name", F.concat(F.lit("cls"), F.col(class_id).cast("string")))).drop("_name")


def append_classes(classes: DataFrame, names: DataFrame) -> DataFrame:
    """The class list with new names at its end: blank ones and ones already there are ignored, names compare exactly.

    `names` has (seq, name), seq unique; of equal names the first counts.
    """
    fresh = names.select("seq", strip(F.col("name")).alias("name")).filter(not_blank(F.col("name"))).groupBy("name").agg(F.min("seq").alias("seq"))
    fresh = fresh.join(classes.select("name"), "name", "left_anti")
    size = classes.agg(F.coalesce(F.max("class_id") + 1, F.lit(0)).alias("size"))
    added = numbered(fresh, "seq", "r").crossJoin(F.broadcast(size))
    return classes.select("class_id", "name").unionByName(added.select((F.col("size") + F.col("r") - 1).cast("int").alias("class_id"), "name"))


def delete_class(classes: DataFrame, position: int) -> DataFrame:
    """The class list without one class; later ones move down."""
    moved = F.col("class_id") - F.when(F.col("class_id") > position, 1).otherwise(0)
    return classes.filter(F.col("class_id") != position).select(moved.cast("int").alias("class_id"), "name")


def remap_labels(boxes: DataFrame, position: int) -> DataFrame:
    """Boxes after `delete_class`, with the ids that the classes now have; boxes of the deleted class go (an addition)."""
    return boxes.filter(F.col("class_id") != position).withColumn("class_id", (F.col("class_id") - F.when(F.col("class_id") > position, 1).otherwise(0)).cast("int"))


def valid_class(class_id: Column, n_classes: Column | int) -> Column:
    return (class_id >= 0) & (class_id < n_classes)


def unlabelled(images: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """Images whose label file is missing or has no bytes. `labels` has (label_path, length)."""
    filled = labels.filter("length > 0").select("label_path").distinct()
    return images.withColumn("label_path", label_path(F.col(path))).join(filled, "label_path", "left_anti").select(*images.columns)


def label_collisions(images: DataFrame, path: str = "path") -> DataFrame:
    """Label paths that several images share (an addition)."""
    return images.groupBy(label_path(F.col(path)).alias("label_path")).agg(F.count(F.lit(1)).alias("n_images")).filter("n_images > 1")


def annotation_counts(images: DataFrame, boxes: DataFrame, path: str = "path") -> DataFrame:
    """Boxes of every image, 0 included."""
    counts = boxes.groupBy(path).agg(F.count(F.lit(1)).alias("n"))
    return images.select(path).join(counts, path, "left").select(path, F.coalesce("n", F.lit(0)).alias("n_boxes"))


def auto_label_counts(images: DataFrame, readable: Column) -> DataFrame:
    """How many images a labelling run tried, and for how many it wrote a file."""
    return images.agg(F.count(F.lit(1)).alias("attempted"), F.count(F.when(readable, 1)).alias("written"))


def reclassify(boxes: DataFrame, chosen: Column, class_id: int) -> DataFrame:
    return boxes.withColumn("class_id", F.when(chosen, F.lit(class_id)).otherwise(F.col("class_id")))


def delete_boxes(boxes: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return boxes.join(keys.select(*on).distinct(), on, "left_anti")


def insert_boxes(boxes: DataFrame, drawn: DataFrame, active_id: int | None) -> DataFrame:
    """Boxes with those drawn added; a box without a class gets the active one, or 0 where none is active."""
    active = max(0, -1 if active_id is None else active_id)
    return boxes.unionByName(drawn.withColumn("class_id", F.coalesce(F.col("class_id"), F.lit(active)).cast("int")))


def drawn_large_enough(w: Column, h: Column) -> Column:
    """Whether a box that was drawn is kept: over four pixels each way."""
    return (w > 4) & (h > 4)


def typed_size(v: Column) -> Column:
    """A typed width or height is one pixel at least."""
    return F.greatest(v, F.lit(1.0))


def shortcut(class_id: Column) -> Column:
    """The key 1 to 9 of the first nine classes; null for others."""
    return F.when(class_id.between(0, 8), class_id + 1)
