"""Sinks: the engine's file formats with their number formats, and deterministic archives."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import tarfile
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain
from typing import BinaryIO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import Violation


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise Violation("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: what is used several times is made once, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refuse_empty(df: DataFrame) -> DataFrame:
    """The rows, or Violation if there are none: an empty table is never written."""
    if df.isEmpty():
        raise Violation("nothing to write")
    return df


def formatted(df: DataFrame, decimals: str = "%.9f", booleans: tuple[str, str] = ("1", "0")) -> DataFrame:
    """All columns as text: doubles by a pattern, not-a-number and null blank, booleans by two words."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.when(c.isNotNull() & ~F.isnan(c), F.format_string(decimals, c))  # a null is not "not a number"
        elif kind == "boolean":
            c = F.when(c, booleans[0]).when(~c, booleans[1])
        elif kind == "array":
            c = F.array_join(c, ";")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, quotes doubled; ``single`` for small tables only."""
    (df.coalesce(1) if single else df).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def scorer_input(df: DataFrame, key: str, tokens: str, path: str) -> None:
    """``id<TAB>tokens`` lines, as scorers read them."""
    df.select(F.concat_ws("\t", key, F.array_join(tokens, " "))).write.text(path)


def files(df: DataFrame, root: str) -> DataFrame:
    """Each row of ``doc_path, content`` as a file under root, written by the executors; ``path, size_bytes`` of what was written.

    ``content`` is text or bytes, null an empty file. A task that is run again writes the same files again. Paths that
    leave the root raise.
    """
    if df.columns != ["doc_path", "content"]:
        raise Violation(f"files need doc_path and content, not {df.columns}")

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri(root))
        made = set()
        for batch in batches:
            paths, sizes = [], []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path, body = path.as_py(), content.as_py() or b""
                body = body.encode() if isinstance(body, str) else body
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise Violation(f"a path that leaves its root: {path}")
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(body)
                paths.append(path)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size_bytes"])

    return written(df.mapInArrow(run, "path string, size_bytes long"), "files")


def uri(path: str) -> str:
    """An address with a scheme; Spark's ``file:/x`` has a slash or three."""
    return f"file://{path}" if path.startswith("/") else re.sub("^file:/+", "file:///", path)


def publish(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy a written folder's files, by the executors, and hash both: ``name, size_bytes, sha256``; any difference raises."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(source)
    name = F.element_at(F.split("path", "/"), -1)
    files(found.select(name.alias("doc_path"), "content"), target)
    one, two = (spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(p).select(name.alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")) for p in (source, target))
    if not one.exceptAll(two).isEmpty() or not two.exceptAll(one).isEmpty():
        raise Violation(f"the copy in {target} differs from {source}")
    return two


@contextmanager
def qa_note(spark: SparkSession, path: str) -> Iterator[None]:
    """Checks inside: if one is violated, a line that says so is written to ``path`` before the violation goes on."""
    try:
        yield
    except Violation as error:
        folder, _, name = path.rpartition("/")
        files(spark.createDataFrame([(name, f"QA failed: {error}\n")], "doc_path string, content string"), folder)
        raise


def legacy_bundle(df: DataFrame, key: str, text: str, path: str, label: str = "0") -> DataFrame:
    """Input of scorers that read a target file and drop its first row: ``path/target.txt`` with the first row doubled, ``path/labels.txt`` with as many
    filler labels, and the row map ``row, key``, from 1, in the order of keys.

    Rows are sorted and written by ranges of keys, a part file each; in the order of their names the parts are the scorer's file. Texts are shuffled
    once; the map is made of keys alone, so rows with the same key are told apart in the file only. ``df`` is read for each of the two, and has to be the same each time.
    """
    from ..operators.order import positions

    lines = df.select(F.col(key).alias("k"), F.regexp_replace(text, r"[\r\n]+", " ").alias("t"))
    lines = lines.withColumn("tie", F.xxhash64("t"))  # ranges are cut by a sample of what is sorted, so no text is in it
    lines.unionByName(lines.orderBy("k", "tie").limit(1)).orderBy("k", "tie").select("t").write.text(f"{path}/target.txt")
    held = positions(lines.select("k"), ["k"], [], "row")
    copies = F.when(F.col("row") == 1, 2).otherwise(1)
    held.select(F.explode(F.array_repeat(F.lit(label), copies)).alias("t")).write.text(f"{path}/labels.txt")
    return held.select("row", F.col("k").alias(key))


def edit_tables(template: DataFrame, scored: DataFrame, stats: DataFrame, root: str) -> None:
    """The three tables of an edit study as CSV: numbers in nine decimals, undefined ones blank; an empty one raises."""
    for name, table in (("template", template), ("scored", scored), ("stats", stats)):
        csv(formatted(refuse_empty(table)), f"{root}/{name}")


def metadata(tables: dict[str, DataFrame], config: dict, outputs: DataFrame | None = None) -> str:
    """JSON with sorted keys: row counts of the tables, the configuration and its digest; ``outputs`` (``name, size_bytes, sha256``): the files written."""
    hashes = {} if outputs is None else {"outputs": {r["name"]: {"size_bytes": r["size_bytes"], "sha256": r["sha256"]} for r in outputs.collect()}}  # a row a file
    body = hashes | {"config": config, "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), "rows": {n: t.count() for n, t in tables.items()}}
    return json.dumps(body, sort_keys=True, indent=1)


def archive(members: dict[str, bytes]) -> bytes:
    """A tar.gz that depends on its members only: sorted, no times, no owners."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name in sorted(members):
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(members[name]), 0o644, 0
            t.addfile(info, io.BytesIO(members[name]))
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", mtime=0, filename="") as z:
        z.write(raw.getvalue())
    return packed.getvalue()


def _small(df: DataFrame, most: int) -> list:
    """The rows of a table for people; a larger one raises, and is never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise Violation(f"more than {most} rows: write a table instead")
    return rows


def _cell(x, decimals: int, missing: str) -> str:
    return missing if x is None or x != x else f"{x:.{decimals}f}" if isinstance(x, float) else str(x)


def latex(df: DataFrame, decimals: int = 3, most: int = 1000) -> str:
    """Rows of a table for a paper."""
    special = {c: f"\\{c}" for c in "&%$#_{}"}
    cell = lambda x: "".join(special.get(c, c) for c in _cell(x, decimals, "--"))
    return "\n".join(" & ".join(map(cell, r)) + r" \\" for r in _small(df, most))


def markdown(df: DataFrame, title: str, note: str = "", decimals: int = 3, most: int = 1000) -> str:
    """A report section: heading, note, table."""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    rows = [line(_cell(x, decimals, "") for x in r) for r in _small(df, most)]
    return "\n".join([f"## {title}", "", *([note, ""] if note else []), line(df.columns), line("---" for _ in df.columns), *rows, ""])


#: The parts of a workbook of one sheet, but for the sheet.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="review" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def column_name(i: int) -> str:
    """A to Z, AA and so on, from 0."""
    return (column_name(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


#: What a cell's XML can't hold as it is, or would be read as something else: written as _xHHHH_, which is how workbooks say a character by its number.
_UNSAID = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _workbook_cell(at: str, x) -> str:
    if x is None:
        return ""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f'<c r="{at}"><v>{x!r}</v></c>'
    said = escape(_UNSAID.sub(lambda m: f"_x{ord(m[0]):04X}_", str(x)))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{said}</t></is></c>'


def write_workbook(out: BinaryIO, rows: Iterable[list], header: list[str]) -> int:
    """A workbook of one sheet, written row by row; how many rows. Cells are inline text or numbers, null ones are left out. The same rows give the same bytes."""
    info = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    with zipfile.ZipFile(out, "w") as z:
        for name, body in _PARTS.items():
            z.writestr(info(name), _HEAD + body, zipfile.ZIP_DEFLATED)
        entry = info("xl/worksheets/sheet1.xml")
        entry.compress_type = zipfile.ZIP_DEFLATED
        n = 0
        with z.open(entry, "w") as sheet:
            sheet.write(f'{_HEAD}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'.encode())
            for n, row in enumerate(chain([header], rows), 1):
                cells = "".join(_workbook_cell(f"{column_name(i)}{n}", x) for i, x in enumerate(row))
                sheet.write(f'<row r="{n}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return n - 1


def workbook(rows: list[list], header: list[str]) -> bytes:
    """The same in memory."""
    out = io.BytesIO()
    write_workbook(out, rows, header)
    return out.getvalue()


def hand_off(packet: DataFrame, key: str, needed: list[str], most: int = 5000) -> bytes:
    """A review packet as a workbook, in the order of its key; released only if every needed cell is filled and no key repeats. Larger packets: ``workbooks.hand_offs``."""
    rows = _small(packet.orderBy(key), most)
    if blank := [r[key] for r in rows if any(r[c] is None or not str(r[c]).strip() for c in [key, *needed])]:
        raise Violation(f"not complete: {blank[:5]}")
    if len({r[key] for r in rows}) < len(rows):
        raise Violation("repeated keys")
    return workbook([list(r) for r in rows], packet.columns)


def _svg(body: str, title: str, width: int, height: int) -> str:
    from xml.sax.saxutils import escape

    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height + 20}"><title>{escape(title)}</title>{body}</svg>'


def histogram_svg(bins: list[tuple[int, int]], title: str, width: int = 640, height: int = 240) -> str:
    """Bars of (bin, count)."""
    return _svg(_bars(bins, width, height), title, width, height)


def _bars(bins: list[tuple[int, int]], width: int, height: int) -> str:
    top = max((n for _, n in bins), default=0) or 1
    step = width / max(1, len(bins))
    return "".join(f'<rect x="{i * step:.1f}" y="{height - n / top * height:.1f}" width="{step * 0.9:.1f}" height="{n / top * height:.1f}"/>' for i, (_, n) in enumerate(sorted(bins)))


def facets_svg(panels: dict[str, list[tuple[int, int]]], title: str, width: int = 320, height: int = 160) -> str:
    """A histogram for each name, side by side."""
    body = "".join(f'<g transform="translate({i * (width + 20)},0)">{_bars(bins, width, height)}<text x="0" y="{height + 15}">{name}</text></g>' for i, (name, bins) in enumerate(sorted(panels.items())))
    return _svg(body, title, (width + 20) * max(1, len(panels)), height)


def _scaled(values: list[float], low: float, high: float, size: int) -> list[float]:
    return [size * (v - low) / ((high - low) or 1) for v in values]


def curve_svg(points: list[tuple[float, float]], title: str, width: int = 640, height: int = 240) -> str:
    """Means of y over means of x, as binned, joined by a line."""
    points = sorted(points)
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    at = list(zip(_scaled(xs, min(xs), max(xs), width), (height - y for y in _scaled(ys, min(ys), max(ys), height)), strict=True))
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
    return _svg(f'<polyline fill="none" stroke="black" points="{line}"/>' + "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3"/>' for x, y in at), title, width, height)


def gaps_svg(gaps: list[tuple[str, float, float, float]], title: str, width: int = 640, row: int = 24) -> str:
    """(name, estimate, low, high): a point with its interval in each row, and a line at zero."""
    ends = [0.0, *(v for _, e, a, b in gaps for v in (e, a, b))]
    low, high = min(ends), max(ends)
    x = lambda v: _scaled([v], low, high, width)[0]
    rows = "".join(f'<line x1="{x(a):.1f}" x2="{x(b):.1f}" y1="{i * row + 12}" y2="{i * row + 12}" stroke="black"/><circle cx="{x(e):.1f}" cy="{i * row + 12}" r="4"/><text x="{width + 8}" y="{i * row + 16}">{name}</text>' for i, (name, e, a, b) in enumerate(gaps))
    return _svg(f'<line x1="{x(0):.1f}" x2="{x(0):.1f}" y1="0" y2="{row * len(gaps)}" stroke="grey"/>{rows}', title, width + 160, row * max(1, len(gaps)))


def boxes_svg(boxes: dict[str, tuple[float, float, float, float, float]], title: str, width: int = 640, row: int = 32) -> str:
    """Least, quartiles and greatest of each name as a box with whiskers."""
    ends = [v for five in boxes.values() for v in five] or [0.0]
    out = []
    for i, (name, five) in enumerate(sorted(boxes.items())):
        a, q, m, r, b = _scaled(list(five), min(ends), max(ends), width)
        y = i * row
        out.append(f'<line x1="{a:.1f}" x2="{b:.1f}" y1="{y + 12}" y2="{y + 12}" stroke="black"/><rect x="{q:.1f}" y="{y + 2}" width="{r - q:.1f}" height="20" fill="white" stroke="black"/><line x1="{m:.1f}" x2="{m:.1f}" y1="{y + 2}" y2="{y + 22}" stroke="black"/><text x="{width + 8}" y="{y + 16}">{name}</text>')
    return _svg("".join(out), title, width + 160, row * max(1, len(boxes)))
