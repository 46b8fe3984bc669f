"""Archives and workbooks as tables: against the standard library, damaged ones, hostile ones, and large ones in pieces."""

import hashlib
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks
from tessera.sources import archives, readers, sinks, workbooks

_FILES = {"a.csv": b"x,y\n1,2\n", "deep/er/b.txt": "\u00e9".encode() * 40_000, "empty": b"", "noise.bin": bytes((i * i * 31 + i // 7) % 251 for i in range(50_000)), "zeros": b"\0" * 300_000}


def _zip(path, files, kind=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", kind) as z:
        z.writestr("deep/", b"")
        for name, body in files.items():
            z.writestr(name, body)


def _tar(path, mode, extra=()):
    with tarfile.open(path, mode) as t:
        folder = tarfile.TarInfo("deep")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, body in _FILES.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        for info in extra:
            t.addfile(info)


def _whole(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.archive, r.name, r.at)):
        key = (r.archive.rsplit("/", 1)[1], r.name)
        body, sha = out.get(key, (b"", None))
        assert r.at == len(body) and sha is None  # no piece behind the last
        out[key] = (body + bytes(r.content), r.sha256)
    return out


@pytest.mark.parametrize(("piece", "block"), [(1000, 1), (4096, 60_000), (8 << 20, 64 << 20)])
def test_members_equal_what_was_packed(spark, tmp_path, piece, block):
    _zip(tmp_path / "one.zip", _FILES)
    _zip(tmp_path / "two.zip", _FILES, zipfile.ZIP_STORED)
    _tar(tmp_path / "three.tar", "w")
    _tar(tmp_path / "four.tgz", "w:gz")
    want = {(a, n): (b, hashlib.sha256(b).hexdigest()) for a in ("one.zip", "two.zip", "three.tar", "four.tgz") for n, b in _FILES.items()}
    found = archives.members(spark, str(tmp_path), piece=piece, block=block)
    assert _whole(found) == want
    assert found.agg(F.max(F.length("content"))).first()[0] <= piece
    assert {k[1] for k in _whole(archives.members(spark, str(tmp_path), "*.csv", piece, block))} == {"a.csv"}
    # Blocks are what tasks are dealt by: with blocks of a byte each member is its own.
    if block == 1:
        blocks = archives.index(spark, str(tmp_path / "two.zip"), block).groupBy("block").count().agg(F.max("count")).first()[0]
        assert blocks <= 2  # an empty member shares the block of the next


@pytest.mark.parametrize("bad", ["../up", "/root", "C:\\x", "a/../../b", "A.CSV"])
def test_hostile_names(spark, tmp_path, bad):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.csv", b"1")
        z.writestr(bad, b"2")
    with pytest.raises(Exception, match="unsafe archive member"):
        archives.members(spark, str(tmp_path))


def test_links_devices_and_damage(spark, tmp_path):
    link, device = tarfile.TarInfo("link"), tarfile.TarInfo("pipe")
    link.type, link.linkname, device.type = tarfile.SYMTYPE, "/etc/passwd", tarfile.FIFOTYPE
    for name, extra, says in (("l", link, "unsafe archive member"), ("d", device, "no plain file")):
        (tmp_path / name).mkdir()
        _tar(tmp_path / name / "x.tar.gz", "w:gz", [extra])
        with pytest.raises(Exception, match=says):
            archives.members(spark, str(tmp_path / name))
    (tmp_path / "z").mkdir()
    _zip(tmp_path / "z/x.zip", _FILES, zipfile.ZIP_STORED)
    whole = (tmp_path / "z/x.zip").read_bytes()
    at = whole.index(_FILES["a.csv"])
    (tmp_path / "z/x.zip").write_bytes(whole[:at] + b"X" + whole[at + 1 :])
    with pytest.raises(Exception, match="not what the archive says"):
        archives.members(spark, str(tmp_path / "z")).collect()


def test_packing_depends_on_rows_only(spark, tmp_path):
    rows = [(f"{i % 3}.zip", f"d{i % 5}/n{i}", f"text {i}" * (i % 7) if i % 4 else None) for i in range(60)]
    made = []
    for parts in (1, 5):
        root = tmp_path / f"p{parts}"
        out = archives.packed(spark.createDataFrame(rows, "archive string, name string, content string").repartition(parts), str(root))
        assert {tuple(r) for r in out.collect()} == {(f"{i}.zip", 20) for i in range(3)}
        made.append({n: (root / n).read_bytes() for n in os.listdir(root) if n.endswith(".zip")})
    assert made[0] == made[1] and len(made[0]) == 3
    found = _whole(archives.members(spark, str(tmp_path / "p1")))
    assert {k: v[0].decode() for k, v in found.items()} == {(a, n): c or "" for a, n, c in rows}
    contract = spark.createDataFrame([(a, n, hashlib.sha256((c or "").encode()).hexdigest()) for a, n, c in rows], "archive string, name string, sha256 string")
    assert archives.bound(archives.members(spark, str(tmp_path / "p1")), contract).count() == 0
    for bad in ([("x.zip", "a", ""), ("x.zip", "A", "")], [("x.zip", "../a", "")], [("d/x.zip", "a", "")]):
        with pytest.raises(Exception, match="twice|unsafe|no folder"):
            archives.packed(spark.createDataFrame(bad, "archive string, name string, content string"), str(tmp_path / "bad"))
    assert archives.packed(spark.createDataFrame([], "archive string, name string, content string"), str(tmp_path / "none")).count() == 0


def _books(spark, path):
    return {(r.book.rsplit("/", 1)[1], r.sheet, f"{r.column}{r.row}"): r.value for r in workbooks.cells(spark, str(path)).collect()}


def test_cells_of_workbooks(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>hello</t></si><si><r><t>two </t></r><r><rPr/><t>runs</t></r><rPh><t>hint</t></rPh></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c><v>5</v></c><c r="AB1" t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>X</t></is></c><c r="D2"/></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row r="7"><c r="C7" t="s"><v>0</v></c></row></sheetData></worksheet>')
    want = {("b.xlsx", 1, "A1"): "hello", ("b.xlsx", 1, "B1"): "5", ("b.xlsx", 1, "AB1"): "two runs", ("b.xlsx", 1, "A2"): "X", ("b.xlsx", 2, "C7"): "hello"}
    assert _books(spark, tmp_path) == want
    (tmp_path / "none").mkdir()
    assert workbooks.cells(spark, str(tmp_path / "none")).count() == 0


def test_packets_of_any_size_and_what_comes_back(spark, tmp_path):
    n = 7001
    packet = spark.range(n).select(F.format_string("k%05d", "id").alias("id"), F.concat(F.lit("a < b & \u00e9\r\n\u0001_x0041_ "), "id").alias("text"), (F.col("id") * 0.5).alias("n"), F.lit(None).cast("string").alias("answer"))
    made = []
    for parts in (1, 6):
        out = workbooks.hand_offs(packet.repartition(parts), "id", ["text"], str(tmp_path / f"p{parts}"), 2000)
        assert {tuple(r) for r in out.collect()} == {(f"packet-{i:06d}.xlsx", 2000 if i < 4 else 1001) for i in range(1, 5)}
        made.append({f: (tmp_path / f"p{parts}" / f).read_bytes() for f in os.listdir(tmp_path / f"p{parts}") if f.endswith(".xlsx")})
    assert made[0] == made[1]
    cells = workbooks.cells(spark, str(tmp_path / "p1"))
    back = workbooks.table(cells, ["id", "text", "n", "answer", "other"])
    assert {(r.id, r.text, float(r.n), r.answer, r.other) for r in back.collect()} == {(f"k{i:05d}", f"a < b & \u00e9\r\n\u0001_x0041_ {i}", i * 0.5, None, None) for i in range(n)}
    assert readers.xlsx(made[0]["packet-000004.xlsx"])["A2"] == "k06000"
    # One cell emptied, one rewritten, one added beside the table, the head of an open column renamed; answers are no changes.
    at = lambda book, row, column: F.col("book").endswith(f"{book:06d}.xlsx") & (F.col("row") == row) & (F.col("column") == column)
    answers = cells.where("column = 'A' and row > 1").withColumns({"column": F.lit("D"), "value": F.lit("yes")})
    more = cells.where(at(2, 5, "A")).withColumns({"column": F.lit("F"), "value": F.lit("note")})
    value = F.when(at(1, 3, "B"), "other").when(at(4, 1, "D"), "reply").when(at(3, 9, "C"), " ").otherwise(F.col("value"))
    returned = cells.where(~at(2, 2, "C")).withColumn("value", value).unionByName(answers).unionByName(more)
    got = {(int(r.book[7:13]), r.row, r.column, r.released, r.returned) for r in workbooks.changed(cells, returned, ["D"]).collect()}
    first = "a < b & \u00e9\r\n\u0001_x0041_ 1"
    assert got == {(1, 3, "B", first, "other"), (2, 2, "C", "1000.0", None), (2, 5, "F", None, "note"), (3, 9, "C", "2003.5", " "), (4, 1, "D", "answer", "reply")}
    for rows, says in (([("a", None)], "not complete"), ([("a", " ")], "not complete"), ([("a", "x"), ("a", "y")], "repeated keys")):
        with pytest.raises(checks.Violation, match=says):
            workbooks.hand_offs(spark.createDataFrame(rows, "id string, text string"), "id", ["text"], str(tmp_path / "no"))


def test_bundles_are_written_by_ranges(spark, tmp_path):
    df = spark.range(5000).select(F.format_string("k%05d", F.col("id")).alias("k"), F.concat(F.lit("t"), "id").alias("t")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sinks.legacy_bundle(df, "k", "t", f"{tmp_path}/b")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.row, r.k) for r in rows.collect()} == {(i + 1, f"k{i:05d}") for i in range(5000)}
    parts = sorted(p for p in os.listdir(tmp_path / "b/target.txt") if p.startswith("part-"))
    lines = [line for p in parts for line in (tmp_path / "b/target.txt" / p).read_text().splitlines()]
    assert len(parts) > 1 and lines == ["t0", *(f"t{i}" for i in range(5000))]
    empty = sinks.legacy_bundle(spark.createDataFrame([], "k string, t string"), "k", "t", f"{tmp_path}/e")
    assert empty.count() == 0 and spark.read.text(f"{tmp_path}/e/target.txt").count() == 0
