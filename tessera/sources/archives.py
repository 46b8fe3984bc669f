"""Archives of any number and size: members as rows, and rows as members, by the executors.

The driver sees names of archives only. Each archive's directory is read and checked by a task, then its members are dealt to tasks
by their bytes, and each task reads its own stretch of the archive. A member comes in pieces, so none has to fit a cell.
"""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import Violation
from .readers import check_names
from .sinks import uri, written

#: Bytes of a member that are one row, and packed bytes of an archive that are one task's work.
PIECE, BLOCK = 8 << 20, 64 << 20

_INDEX = "archive string, kind string, name string, start long, packed long, size_bytes long, crc long, deflated boolean, block int"
_MEMBERS = "archive string, name string, size_bytes long, at long, content binary, sha256 string"


@contextmanager
def opened(path: str) -> Iterator[pa.NativeFile]:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri(path))
    with system.open_input_file(at) as file:
        yield file


def _zipped(file: pa.NativeFile) -> list[dict]:
    found = []
    with zipfile.ZipFile(file) as z:
        infos = z.infolist()
    check_names([(i.filename, (i.external_attr >> 16) & 0o170000 == 0o120000) for i in infos])
    for i in infos:
        if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise Violation(f"a member that is locked or packed in another way: {i.filename}")
        if not i.is_dir():
            found.append({"name": i.filename, "start": i.header_offset, "packed": i.compress_size, "size_bytes": i.file_size, "crc": i.CRC, "deflated": i.compress_type == zipfile.ZIP_DEFLATED})
    return sorted(found, key=lambda m: m["start"])


def _tarred(file) -> list[dict]:
    found, names = [], []
    with tarfile.open(fileobj=file, mode="r:") as t:
        for m in t:
            names.append((m.name.rstrip("/"), m.issym() or m.islnk()))
            if m.isreg() and m.sparse is None:
                found.append({"name": m.name, "start": m.offset_data, "packed": m.size, "size_bytes": m.size, "crc": None, "deflated": False})
            elif not m.isdir() and not names[-1][1]:
                raise Violation(f"a member that is no plain file: {m.name}")
            t.members = []  # what tarfile would keep for each member
    check_names(names)
    return found


def _directory(path: str, block: int) -> tuple[str, list[dict]]:
    """An archive's kind, and its plain members in the order of their bytes, with the number of the block that each begins in."""
    with opened(path) as file:
        magic = file.read(4)
        file.seek(0)
        if magic[:2] == b"PK":
            kind, found = "zip", _zipped(file)
        elif magic[:2] == b"\x1f\x8b":
            kind = "tar.gz"
            with gzip.GzipFile(fileobj=file) as plain:
                found = _tarred(plain)
        else:
            kind, found = "tar", _tarred(file)
    done = 0
    for m in found:
        m["block"] = 0 if kind == "tar.gz" else done // block
        done += m["packed"]
    return kind, found


def index(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``archive, kind, name, start, packed, size_bytes, crc, deflated, block`` of the plain files in the archives (zip, tar, tar.gz) under a path.

    A name that is absolute or climbs, a link, two names of an archive that differ by case only, a locked member or a device raise, before any
    member is read. Folders are left out. A zip's directory and a tar's headers are all that is read, but for tar.gz, which is read through.
    """

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                kind, found = _directory(archive, block)
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist([{"archive": archive, "kind": kind} | m for m in found[at : at + 10_000]], schema=_arrow(_INDEX))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return written(files.mapInArrow(run, _INDEX), "index")


def _arrow(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in columns.split(", "))])


def _stretch(file, size: int, piece: int) -> Iterator[bytes]:
    while size:
        body = file.read(min(size, piece))
        if not body:
            raise Violation("an archive that ends early")
        size -= len(body)
        yield body


def _inflated(parts: Iterator[bytes], piece: int) -> Iterator[bytes]:
    """Plain bytes of a deflated member, at most ``piece`` at a time, however well it was packed."""
    engine = zlib.decompressobj(-15)
    for part in parts:
        while part:
            yield engine.decompress(part, piece)
            part = engine.unconsumed_tail
    while not engine.eof:
        rest = engine.decompress(b"", piece)
        if not rest:
            raise Violation("a member that ends early")
        yield rest


def _pieces(file, m: dict, piece: int) -> Iterator[tuple[int, bytes, str | None]]:
    """``at, content, sha256`` of a member's pieces; the digest of the whole stands on its last piece."""
    start = m["start"]
    if m["kind"] == "zip":
        file.seek(start)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise Violation(f"no member at {start} of {m['archive']}")
        start += 30 + sum(struct.unpack("<HH", head[26:30]))
    file.seek(start)
    parts = _stretch(file, m["packed"], piece)
    parts = _inflated(parts, piece) if m["deflated"] else parts
    digest, crc, at, held = hashlib.sha256(), 0, 0, b""
    for part in parts:
        digest.update(part)
        crc = zlib.crc32(part, crc)
        held += part
        while len(held) > piece:
            yield at, held[:piece], None
            at, held = at + piece, held[piece:]
    if at + len(held) != m["size_bytes"] or (m["crc"] is not None and crc != m["crc"]):
        raise Violation(f"not what the archive says: {m['name']} in {m['archive']}")
    yield at, held, digest.hexdigest()


def members(spark: SparkSession, path: str, include: str | None = None, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """``archive, name, size_bytes, at, content, sha256``: files in the archives under a path whose names match a glob, in pieces of up to ``piece`` bytes.

    ``at``: how many of the file's bytes lie before the piece. ``sha256``: of the whole file, on its last piece, else null. An empty file is one empty
    piece. Stretches of about ``block`` packed bytes are read by a task each; a tar.gz can't be entered midway and is one task's. A damaged
    member raises.
    """

    def run(batches):
        for batch in batches:
            rows, held, file, name, way = [], 0, None, None, None
            for m in batch.to_pylist():
                if include is not None and not fnmatch.fnmatchcase(m["name"], include):
                    continue
                if m["archive"] != name:
                    if way is not None:
                        way.__exit__(None, None, None)
                    name, way = m["archive"], opened(m["archive"])
                    file = way.__enter__()
                    file = gzip.GzipFile(fileobj=file) if m["kind"] == "tar.gz" else file
                for at, content, sha in _pieces(file, m, piece):
                    rows.append({"archive": m["archive"], "name": m["name"], "size_bytes": m["size_bytes"], "at": at, "content": content, "sha256": sha})
                    held += len(content)
                    if held >= piece or len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_MEMBERS))
                        rows, held = [], 0
            if way is not None:
                way.__exit__(None, None, None)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_MEMBERS))

    dealt = index(spark, path, block).repartition("archive", "block").sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(run, _MEMBERS)


def bound(found: DataFrame, contract: DataFrame) -> DataFrame:
    """``archive, name, problem``: members that a contract ``(archive, name, sha256)`` lacks, that it names and that are missing, or that differ from it.

    Archives are told by the ends of their paths.
    """
    have = found.where(F.col("sha256").isNotNull()).select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "name", F.col("sha256").alias("own"))
    both = contract.select("archive", "name", "sha256").join(have, ["archive", "name"], "full")
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "not in the contract").when(F.col("own") != F.col("sha256"), "differs")
    return both.select("archive", "name", problem.alias("problem")).where("problem is not null")


def packed(df: DataFrame, root: str) -> DataFrame:
    """Rows of ``archive, name, content`` as zip archives under root; ``archive, members`` of what was written.

    An archive is written by one task as a stream, its members in the order of their names and without times, so the same rows give the same bytes. It
    appears under its name only when it is whole. ``content`` is text or bytes, null an empty file. Unsafe names and repeated ones raise, also if they differ by case only.
    """
    if df.columns != ["archive", "name", "content"]:
        raise Violation(f"archives need archive, name and content, not {df.columns}")

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri(root))
        system.create_dir(base, recursive=True)
        now = out = z = before = None
        count, made = 0, []

        def close():
            z.close()
            out.close()
            system.move(f"{base}/.{now}.part-{tag}", f"{base}/{now}")
            made.append((now, count))

        from pyspark import TaskContext

        tag = TaskContext.get().taskAttemptId()
        for batch in batches:
            for archive, name, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                archive, name, body = archive.as_py(), name.as_py(), content.as_py() or b""
                if archive != now:
                    if now is not None:
                        close()
                    check_names([(archive, False)])
                    if "/" in archive:
                        raise Violation(f"an archive's name has no folder: {archive}")
                    now, before, count = archive, None, 0
                    out = system.open_output_stream(f"{base}/.{now}.part-{tag}")
                    z = zipfile.ZipFile(out, "w")
                check_names([(name, False)])
                if name.lower() == before:
                    raise Violation(f"a name that comes twice in {archive}: {name}")
                before, count = name.lower(), count + 1
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
                z.writestr(info, body)
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.string()), pa.array([c for _, c in made], pa.int64())], names=["archive", "members"])

    return written(df.repartition("archive").sortWithinPartitions("archive", F.lower("name"), "name").mapInArrow(run, "archive string, members long"), "archives")
