"""Workbooks of any number and size as tables of cells, and packets of any size as workbooks.

Sheets and shared strings are read as streams of XML events by one task a part; what they hold meets in joins.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import Violation
from ..operators.order import positions
from .archives import opened
from .sinks import uri, write_workbook, written

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_STRINGS = "xl/sharedStrings.xml"
_FOUND = "book string, part string, row int, column string, value string, shared long"
_ARROW = pa.schema([("book", pa.string()), ("part", pa.string()), ("row", pa.int32()), ("column", pa.string()), ("value", pa.string()), ("shared", pa.int64())])
_BATCH = 10_000


def _ended(file, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; what was read is let go."""
    open_elements: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(file, events=("start", "end")):
        if event == "start":
            open_elements.append(element)
            continue
        open_elements.pop()
        if element.tag == _MAIN + name:
            yield element
            if open_elements:
                open_elements[-1].remove(element)


def _text(element: ElementTree.Element) -> str:
    """Runs of text, without the phonetic hints beside them."""
    said = "".join(t.text or "" for child in ([element] if element.find(_MAIN + "r") is None else element.iterfind(_MAIN + "r")) for t in child.iterfind(_MAIN + "t"))
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), said)


def _cells(file) -> Iterator[tuple[int, str, str | None, int | None]]:
    """``row, column, value, shared`` of the cells that hold something; a cell or row without a reference follows the one before it."""
    row = 0
    for line in _ended(file, "row"):
        row = int(line.get("r") or row + 1)
        column = 0
        for c in line.iterfind(_MAIN + "c"):
            at = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r") or "")
            if at:
                row, column = int(at[2]), 0
                for letter in at[1]:
                    column = column * 26 + ord(letter) - 64
            else:
                column += 1
            value, kind = c.find(_MAIN + "v"), c.get("t")
            if kind == "inlineStr":
                inline = c.find(_MAIN + "is")
                yield row, column, "" if inline is None else _text(inline), None
            elif value is not None and kind == "s":
                yield row, column, None, int(value.text)
            elif value is not None:
                yield row, column, value.text or "", None


def _letters(i: int) -> str:
    out = ""
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def cells(spark: SparkSession, path: str) -> DataFrame:
    """``book, sheet, row, column, value``: the cells that hold something in all workbooks under a path; ``sheet`` is its number, ``column`` its letters.

    Values are text as it is stored. A sheet is one task's work and is never whole in memory, nor are the shared strings, which are joined by their numbers.
    """

    def parts(batches):
        for batch in batches:
            for book in batch.column(0).to_pylist():
                with opened(book) as file, zipfile.ZipFile(file) as z:
                    names = [n for n in z.namelist() if n == _STRINGS or re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)]
                yield pa.RecordBatch.from_pydict({"book": [book] * len(names), "part": names}, schema=pa.schema([("book", pa.string()), ("part", pa.string())]))

    def read(batches):
        for batch in batches:
            for one in batch.to_pylist():
                book, part = one["book"], one["part"]
                with opened(book) as file, zipfile.ZipFile(file) as z, z.open(part) as stream:
                    if part == _STRINGS:
                        found = ({"book": book, "part": None, "row": None, "column": None, "value": _text(si), "shared": i} for i, si in enumerate(_ended(stream, "si")))
                    else:
                        found = ({"book": book, "part": part, "row": r, "column": _letters(c), "value": x, "shared": s} for r, c, x, s in _cells(stream))
                    held = []
                    for row in found:
                        held.append(row)
                        if len(held) == _BATCH:
                            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!.~_]*.xlsx").load(path).select("path")
    found = written(files.mapInArrow(parts, "book string, part string").repartition("book", "part").mapInArrow(read, _FOUND), "cells")
    placed = found.where("part is not null")
    strings = found.where("part is null").select("book", "shared", F.col("value").alias("text"))
    named = placed.where("shared is null").unionByName(placed.where("shared is not null").drop("value").join(strings, ["book", "shared"], "left").withColumnRenamed("text", "value"))
    return named.select("book", F.regexp_extract("part", r"sheet([0-9]+)\.xml", 1).cast("int").alias("sheet"), "row", "column", "value")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("book", F.element_at(F.split("book", "/"), -1))


def changed(released: DataFrame, returned: DataFrame, open_columns: list[str]) -> DataFrame:
    """``book, sheet, row, column, released, returned``: cells that a returned workbook changed, added or lost, outside the columns meant to be filled in.

    The first row is never open. Both are tables of ``cells``; books are told by their file names, and a book that came back without having been released
    differs in all its cells. What is blank is no cell.
    """
    place = ["book", "sheet", "row", "column"]
    one, two = (_named(d).where(~F.col("column").isin(open_columns) | (F.col("row") == 1)).select(*place, F.nullif("value", F.lit("")).alias(n)).where(F.col(n).isNotNull()) for d, n in ((released, "released"), (returned, "returned")))
    return one.join(two, place, "full").where(~F.col("released").eqNullSafe(F.col("returned")))


def table(found: DataFrame, names: list[str]) -> DataFrame:
    """``book, sheet, row`` and the named columns, by the names in the first row of each sheet; blank cells and columns that a sheet lacks are null."""
    place = ["book", "sheet"]
    head = found.where("row = 1").groupBy(*place).agg(*(F.min(F.when(F.col("value") == n, F.col("column"))).alias(f"__{i}") for i, n in enumerate(names)))
    rows = found.where("row > 1").groupBy(*place, "row").agg(F.map_from_entries(F.collect_list(F.struct("column", F.coalesce("value", F.lit(""))))).alias("__cells"))  # one row's cells
    return rows.join(head, place, "left").select(*place, "row", *(F.nullif(F.try_element_at("__cells", F.col(f"__{i}")), F.lit("")).alias(n) for i, n in enumerate(names)))


def hand_offs(packet: DataFrame, key: str, needed: list[str], root: str, rows: int = 50_000) -> DataFrame:
    """A packet of any size as workbooks of ``rows`` rows each under root, in the order of the key; ``book, rows`` of what was written.

    Released only if every needed cell is filled and no key repeats; else Violation, and nothing is written. Each book is a stream that one task
    writes, and appears under its name only when it is whole. The same packet gives the same books.
    """
    if blank := packet.where(" or ".join(f"nullif(btrim(cast(`{c}` as string)), '') is null" for c in [key, *needed])).select(key).take(5):
        raise Violation(f"not complete: {[r[0] for r in blank]}")
    if twice := packet.groupBy(key).count().where("count > 1").select(key).take(5):
        raise Violation(f"repeated keys: {[r[0] for r in twice]}")
    header = packet.columns
    placed = positions(packet, [key], [], "__at", "__all").drop("__all").withColumn("__book", F.floor((F.col("__at") - 1) / rows))

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(uri(root))
        system.create_dir(base, recursive=True)
        tag = TaskContext.get().taskAttemptId()
        lines = (row for batch in batches for part in _sliced(batch) for row in part.to_pylist())
        for number, own in groupby(lines, key=lambda r: r["__book"]):
            name = f"packet-{number + 1:06d}.xlsx"
            with system.open_output_stream(posixpath.join(base, f".{name}.part-{tag}")) as out:
                count = write_workbook(out, ([r[c] for c in header] for r in own), header)
            system.move(posixpath.join(base, f".{name}.part-{tag}"), posixpath.join(base, name))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([count], pa.int64())], names=["book", "rows"])

    return written(placed.repartition("__book").sortWithinPartitions("__book", "__at").mapInArrow(run, "book string, rows long"), "books")


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 1000):
        yield batch.slice(at, 1000)
