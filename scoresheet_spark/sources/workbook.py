"""Spreadsheets: the first sheet of .xlsx files as rows of text, and a sheet written back. Standard library only."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from itertools import chain, islice
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Rows that a sheet can hold, its header included; a fixed value.
MAX_ROWS = 1_048_576
#: Rows of each spreadsheet of many, and rows that a reader's task hands on at once.
SHEET_ROWS, READ_ROWS = 50_000, 5_000
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _elements(part: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one at a time: each goes with its parent's other children once it has been looked at."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == f"{_NS}{tag}":
            yield element
            if above:
                above[-1].clear()


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet, in the workbook's order, as text; None for empty ones, numbers as they are stored. Rows are read as they are asked for."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in _elements(part, "si")]
        sheet = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}sheets/{_NS}sheet")
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(f"{_REL}id"))
        first = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with z.open(first) as part:
            for row in _elements(part, "row"):
                cells: dict[int, str | None] = {}
                for i, c in enumerate(row.iter(f"{_NS}c")):
                    v, kind = c.find(f"{_NS}v"), c.get("t")
                    said = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else None if v is None else v.text
                    if kind == "s" and said is not None:
                        said = shared[int(said)]
                    elif kind == "b" and said is not None:
                        said = "True" if said == "1" else "False"
                    cells[_column(c.get("r")) if c.get("r") else i] = said
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def parse_sheet(content: bytes) -> list[list[str | None]]:
    """All rows of `sheet_rows`."""
    return list(sheet_rows(content))


def build_sheet(header: list[str], rows: Iterator[tuple]) -> bytes:
    """An .xlsx file with one sheet of text cells."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for i, row in enumerate(chain([header], rows)):
                if i >= MAX_ROWS:
                    raise ValueError(f"a sheet holds {MAX_ROWS} rows at most")
                cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if v is not None else "<c/>" for v in row)
                sheet.write(f"<row>{cells}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a spreadsheet (or of several with the same header) as text columns; a .csv file likewise."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=False)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    kind = "path string, n bigint, cells array<string>"

    def cells(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0), b.column(1), strict=True):
                rows, n = islice(sheet_rows(content.as_py()), most), 0
                while part := list(islice(rows, READ_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(part), pa.string()), pa.array(range(n, n + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], names=["path", "n", "cells"])
                    n += len(part)

    header = files.mapInArrow(lambda batches: cells(batches, 1), kind).orderBy("path").first()  # of each file the first row alone is parsed
    rows = files.mapInArrow(cells, kind)
    names = [h or f"column_{i}" for i, h in enumerate(header["cells"])] if header else []
    return rows.filter("n > 0").select(*(F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)))


def write_workbook(df: DataFrame, path: str) -> None:
    """One spreadsheet of all rows, streamed through the driver: a sheet's own row limit bounds it. `write_workbooks` has no limit."""
    if path.lower().endswith(".csv"):
        df.coalesce(1).write.mode("overwrite").csv(path, header=True)
        return
    spark = df.sparkSession
    content = build_sheet(df.columns, (tuple(r) for r in df.toLocalIterator()))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_workbooks(df: DataFrame, folder: str, rows: int = SHEET_ROWS) -> None:
    """A new folder of spreadsheets with the same header, which `read_workbook` reads as one: `rows` rows at most each, by the executors.

    Cells are what Spark casts to text, booleans as True and False. Tasks write into a folder aside, from which the files of attempts that
    did not count are dropped before it is renamed: the folder is there whole or not at all. Without rows there is one file with the header.
    """
    if not 0 < rows < MAX_ROWS:
        raise ValueError(f"a sheet holds {MAX_ROWS} rows at most, its header included")
    spark, header = df.sparkSession, df.columns
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    target = fs.makeQualified(fs_path(folder))
    if fs.exists(target):
        raise FileExistsError(folder)
    aside = f"{target.toString()}.new-{uuid.uuid4().hex}"
    cell = lambda f: F.initcap(F.col(f"`{f.name}`").cast("string")) if f.dataType == BooleanType() else F.col(f"`{f.name}`").cast("string")
    texts = df.select(*(cell(f).alias(f"c{i}") for i, f in enumerate(df.schema)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        system, at = arrow_fs.FileSystem.from_uri(aside) if "://" in aside else (arrow_fs.LocalFileSystem(), aside.removeprefix("file:"))
        system.create_dir(at, recursive=True)
        left = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        while (first := next(left, None)) is not None:
            name = f"part-{uuid.uuid4().hex}.xlsx"
            with system.open_output_stream(f"{at}/{name}") as out:
                out.write(build_sheet(header, chain([first], islice(left, rows - 1))))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["name"])

    try:
        told = {r["name"] for r in texts.mapInArrow(write, "name string").collect()}  # a name for each file
        fs.mkdirs(fs_path(aside))
        for f in fs.listStatus(fs_path(aside)):
            if f.getPath().getName() not in told:
                fs.delete(f.getPath(), True)
        if not told:
            out = fs.create(fs_path(f"{aside}/part-{uuid.uuid4().hex}.xlsx"), True)
            out.write(bytearray(build_sheet(header, iter(()))))
            out.close()
        if not fs.rename(fs_path(aside), target):
            raise OSError(f"{aside} could not be renamed")
    finally:
        fs.delete(fs_path(aside), True)
