"""Files of an annotated image folder: images, class list, labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, label_path, not_blank, six_decimals, strip, tokens

#: File extensions of images; fixed values.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(IMAGE_EXTENSIONS)})$")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length) of the images of a folder, by path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.filter(is_image(F.col("path"))).select("path", basename(F.col("path")).alias("name"), "length").orderBy("path")


def catalogue(paths: DataFrame, path: str = "path") -> DataFrame:
    """Images among paths, with their names and where their labels lie."""
    return paths.filter(is_image(F.col(path))).select(path, basename(F.col(path)).alias("name"), label_path(F.col(path)).alias("label_path"))


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name): the non-blank lines of a class list; the place among them is the id."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    names = F.transform(F.filter("lines", not_blank), strip)
    return lines.select(F.posexplode(names).alias("class_id", "name"))


def class_list_text(classes: DataFrame) -> DataFrame:
    """One row: the text of the class list."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("class_id", "name"))), lambda x: x["name"])
    return classes.agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("value"))


def parse_label_lines(lines: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """(path, class_id, cx, cy, bw, bh) of label lines; lines with fewer than five fields are left out, further fields ignored.

    A field that is no number is null.
    """
    t = lines.select(path, tokens(F.col(value)).alias("t")).filter(F.size("t") >= 5)
    number = lambda i: F.col("t")[i].try_cast("double")
    return t.select(path, F.col("t")[0].try_cast("int").alias("class_id"), number(1).alias("cx"), number(2).alias("cy"), number(3).alias("bw"), number(4).alias("bh"))


def list_label_files(spark: SparkSession, folder: str) -> DataFrame:
    """(label_path, length) of the label files of a folder and the folders in it. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("label_path"), "length")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all label files of a folder and the folders in it, with each file's path and `seq`, the box's place in the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    lines = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("seq", "value"))
    parsed = parse_label_lines(lines.select(F.struct("path", "seq").alias("at"), "value"), "at")
    return parsed.select("at.path", "at.seq", *(c for c in parsed.columns if c != "at"))


def format_label(boxes: DataFrame) -> DataFrame:
    """`boxes` with `line`: class and four six-decimal shares."""
    return boxes.withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), *(six_decimals(F.col(c)) for c in ("cx", "cy", "bw", "bh"))))


def label_files(images: DataFrame, boxes: DataFrame, path: str = "path") -> DataFrame:
    """(path, text) of every image's label file, empty where it has no box.

    Lines are in the order in which boxes were drawn, where they have a `seq`, else in order of class and place. An
    image has few boxes: they are gathered into its text.
    """
    lines = format_label(boxes)
    line = F.struct("seq", "line") if "seq" in boxes.columns else F.struct("line")
    lines = lines.groupBy(path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))
    return images.select(path).join(lines, path, "left").select(path, F.coalesce("text", F.lit("")).alias("text"))


def write_label_files(files: DataFrame, path: str = "path", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the label file of each image, beside it or under `folder` by its whole path, and tells (label_path, length).

    Executors write the files, each by way of a name of its own that is moved at the end: a task that runs again leaves
    the same file. An empty text makes a file without bytes. Nothing is written until the result is read.
    """
    named = files.select(label_path(F.col(path)).alias("label_path"), F.col(text).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        for b in batches:
            told = []
            for label, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bare = label.removeprefix("file:")
                target = f"{folder.removeprefix('file:').rstrip('/')}/{bare.split('://', 1)[-1].lstrip('/')}" if folder else bare
                system, at = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                data = said.encode() + b"\n" if said else b""
                staged = f"{at}.{uuid.uuid4().hex}"
                with system.open_output_stream(staged) as out:
                    out.write(data)
                system.move(staged, at)
                told.append((target, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.int64())], names=["label_path", "length"])

    return named.mapInArrow(write, "label_path string, length bigint")
