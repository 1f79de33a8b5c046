"""Spreadsheet workbooks (ECMA-376 packages), read with the standard library (A01, A02, and the spans, tables and names that B01 to B21 need).

read_workbooks(spark, path) gives the non-empty cells of all sheets in long form: sheet, state,
row, col, kind and value, from any file system of Spark's; so does the data source
("workbook"), from paths that all executors mount. A workbook is read by one task, sheet by
sheet, row by row, whatever its size; only its packed bytes and shared texts are in memory.
"""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

CELL = "sheet string, state string, row int, col int, kind string, value string"
KINDS = {"s": "text", "str": "text", "inlineStr": "text", "b": "bool", "e": "error", "d": "date"}


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _package(f: BinaryIO) -> zipfile.ZipFile:
    if f.read(8).startswith(b"\xd0\xcf\x11\xe0"):
        raise ValueError("the workbook is encrypted or in the old binary format")
    f.seek(0)
    return zipfile.ZipFile(f)


def cells(f: BinaryIO) -> Iterator[tuple]:
    with _package(f) as z:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(PACKAGE + "Relationship")}
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ET.iterparse(f):
                    if e.tag == MAIN + "si":
                        shared.append("".join(t.text or "" for t in e.iter(MAIN + "t")))
                        e.clear()
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(MAIN + "sheet"):
            target = targets[sheet.get(RELATION)].lstrip("/")
            with z.open(target if target.startswith("xl/") else "xl/" + target) as f:
                for _, row in ET.iterparse(f):
                    if row.tag != MAIN + "row":
                        continue
                    for c in row.iter(MAIN + "c"):
                        letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                        kind, v = c.get("t"), c.findtext(MAIN + "v")
                        if kind == "s" and v is not None:
                            v = shared[int(v)]
                        elif kind == "inlineStr":
                            v = "".join(t.text or "" for t in c.iter(MAIN + "t"))
                        if v is not None and v != "":
                            yield sheet.get("name"), sheet.get("state", "visible"), int(number), column_number(letters), KINDS.get(kind, "number"), v
                    row.clear()


REF = r"\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?"


def _box(ref: str) -> tuple[int, int, int, int] | None:
    m = re.fullmatch(REF, ref or "")
    if not m:
        return None
    left, top = column_number(m[1]), int(m[2])
    return top, left, int(m[4] or top), column_number(m[3] or m[1])


def spans(f: BinaryIO) -> Iterator[tuple]:
    """(kind, sheet, top, left, bottom, right, name): merged cells, declared tables, and names of one range."""
    with _package(f) as z:
        names = set(z.namelist())
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(PACKAGE + "Relationship")}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        for sheet in book.iter(MAIN + "sheet"):
            target = targets[sheet.get(RELATION)].lstrip("/")
            part = target if target.startswith("xl/") else "xl/" + target
            with z.open(part) as own:
                for _, e in ET.iterparse(own):
                    if e.tag == MAIN + "mergeCell" and (box := _box(e.get("ref"))):
                        yield "merge", sheet.get("name"), *box, None
                    if e.tag == MAIN + "row":
                        e.clear()
            folder, _, file = part.rpartition("/")
            if (links := f"{folder}/_rels/{file}.rels") in names:
                for r in ET.fromstring(z.read(links)).iter(PACKAGE + "Relationship"):
                    if r.get("Type", "").endswith("/table"):
                        table = ET.fromstring(z.read(posixpath.normpath(f"{folder}/{r.get('Target')}").lstrip("/")))
                        if box := _box(table.get("ref")):
                            yield "table", sheet.get("name"), *box, table.get("displayName") or table.get("name")
        for e in book.iter(MAIN + "definedName"):
            sheet, _, ref = (e.text or "").rpartition("!")
            if sheet and "," not in sheet and (box := _box(ref)):  # names of several ranges have a comma
                yield "range", sheet.strip("'").replace("''", "'"), *box, e.get("name")


def _read(spark: SparkSession, path: str, rows_of: Callable[[BinaryIO], Iterator[tuple]], ddl: str) -> DataFrame:
    names = ["path", *[f.split()[0] for f in ddl.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                rows = ((where, *row) for row in rows_of(io.BytesIO(content)))
                while part := list(itertools.islice(rows, 50_000)):
                    yield pd.DataFrame(part, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xlsx,xlsm}").load(path)
    return files.select("path", "content").mapInPandas(run, f"path string, {ddl}")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, cells, CELL)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, spans, "kind string, sheet string, top int, left int, bottom int, right int, name string")


class WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(re.sub(r"^file:(//)?", "", partition.value), "rb") as f:
            yield from cells(f)


class WorkbookSource(DataSource):
    """Option path: one or more workbooks, parted by commas, on a file system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELL

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader([p.strip() for p in self.options["path"].split(",")])
