"""Merkle fixity audit of web archives.

A record is a slot of an archive file, at a byte offset. Its leaf is the SHA-256 of its content and place;
a node hashes the ordered leaves or nodes of ``fan`` consecutive slots, so its subject is an ordered
offset range. Two replicas compare the roots of their archives, then descend only below nodes
that differ: each level is an equi-join of the few children of mismatching nodes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

RECORD = "archive {kind}, slot int, offset long, length long, sha256 string"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", per_archive: int = 4096) -> DataFrame:
    """Pages laid out as archive records: ``archive, slot, offset, length, sha256``.

    The key numbers the records; ``per_archive`` consecutive numbers share an archive file, in which a
    record's offset is the length of those before it. Null url or html counts as empty but hashes
    unlike it. Rows that repeat a key are one slot: its digest covers all of them, whatever their order.
    Rows with a null key have no place: archive, slot and offset are null, one record for each content,
    as long as all its rows.
    """
    k = F.col(f"`{key}`")
    body = F.concat(F.lit("url "), F.coalesce(F.concat(F.lit("="), F.col(f"`{url}`")), F.lit("-")), F.lit("\n"), F.coalesce(F.concat(F.lit("="), F.col(f"`{html}`")), F.lit("-")))
    rows = pages.select(F.floor(k / per_archive).cast("long").alias("archive"), F.pmod(k, F.lit(per_archive)).cast("int").alias("slot"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("length"))
    rows = rows.withColumn("loose", F.when(F.col("archive").isNull(), F.col("sha256")))
    # Rows of one slot are summed, not listed: the digest of several is that of the sums of their hashes' parts.
    sums = [F.sum(F.conv(F.substring("sha256", 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    one = rows.groupBy("archive", "slot", "loose").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"), F.min("sha256").alias("least"), *sums)
    several = F.sha2(F.concat_ws(",", "n", *(f"s{i}" for i in range(5))), 256)
    one = one.select("archive", "slot", "loose", "length", F.when((F.col("n") == 1) | F.col("loose").isNotNull(), F.col("least")).otherwise(several).alias("sha256"))
    before = Window.partitionBy("archive", "loose").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most per_archive rows
    offset = F.when(F.col("archive").isNotNull(), F.coalesce(F.sum("length").over(before), F.lit(0)))
    return one.select("archive", "slot", offset.cast("long").alias("offset"), "length", "sha256")


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or in gzip members: ``archive`` (the file's name), ``slot, offset, length, sha256``.

    ``path``: a folder or glob. A file is one task's work and is read in pieces of a megabyte: a record is never held
    whole. offset and length are bytes of the file as it lies there, sha256 is over header and block,
    uncompressed. What stands where a record should begin, a record that is cut off, and one that can't be
    unpacked, is the last record of its file, up to the end. Files without bytes have no records.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
                with system.open_input_stream(at, compression=None) as stream:
                    rows = list(_members(stream))  # some eighty bytes a record
                columns = zip(*rows, strict=True) if rows else [[], [], []]
                o, n, h = (list(c) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(o), pa.string()), pa.array(range(len(o)), pa.int32()), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.string())], names=["archive", "slot", "offset", "length", "sha256"])

    # Each file a task of its own, the longest first.
    spread = files.repartition(max(1, min(files.count(), 10_000)), "path").sortWithinPartitions(F.desc("size"))
    return spread.select("path").mapInArrow(run, RECORD.format(kind="string"))


PIECE = 1 << 20


class _Source:
    """Bytes of a file, unpacked if they are gzip members, and where in the file they come from."""

    def __init__(self, stream):
        self.stream, self.held, self.place, self.unpack = stream, stream.read(PIECE), 0, None
        self.packed, self.broken = self.held[:2] == b"\x1f\x8b", False
        self.ready = b""

    def begin(self) -> None:
        """Make ready for the next member, if there is one."""
        self.held = self.held or self.stream.read(PIECE)
        self.unpack = zlib.decompressobj(31) if self.packed and self.held else None

    def more(self) -> bool:
        """Another piece in ``ready``; False at the end of the file or, of packed ones, of a member."""
        if not self.held:
            self.held = self.stream.read(PIECE)
        if not self.packed:
            self.ready += self.held
            self.place, self.held, got = self.place + len(self.held), b"", bool(self.held)
            return got
        if self.unpack is None:
            return False
        while self.held and not self.unpack.eof:
            try:
                new = self.unpack.decompress(self.held, PIECE)
            except zlib.error:  # damaged: the rest of the file is taken as it lies there
                self.packed, self.broken = False, True
                return self.more()
            rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            self.place, self.held = self.place + len(self.held) - len(rest), rest
            if new:
                self.ready += new
                return True
            if not self.held and not self.unpack.eof:
                self.held = self.stream.read(PIECE)
        return False


def _members(stream) -> Iterator[tuple[int, int, str]]:
    """(offset, length, digest) of each record of a file."""
    source = _Source(stream)
    while True:
        start = source.place - len(source.ready)
        source.begin()
        digest, whole = hashlib.sha256(), True
        while b"\r\n\r\n" not in source.ready and len(source.ready) < PIECE:
            if not source.more():
                break
        if not source.ready:
            return
        head, mark, _ = source.ready.partition(b"\r\n\r\n")
        sizes = [line.split(b":", 1)[1].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        whole = bool(mark) and head.startswith(b"WARC/") and len(sizes) == 1 and sizes[0].isdigit()
        left = len(head) + 4 + int(sizes[0]) + 4 if whole else None  # with the two line ends behind the block
        while left is None or left > 0:
            part = source.ready if left is None else source.ready[:left]
            digest.update(part)
            source.ready = source.ready[len(part) :]
            left = None if left is None else left - len(part)
            if left == 0 or (not source.ready and not source.more()):
                break
            left = None if source.broken else left
        if source.packed:
            while source.more():  # what a member holds behind its record belongs to it
                pass
            digest.update(source.ready)
            source.ready = b""
        yield start, source.place - len(source.ready) - start, digest.hexdigest()


def tree(leaves: DataFrame, fan: int = 16, per_archive: int = 4096) -> DataFrame:
    """All nodes: ``level, archive, node, start, stop, hash``; level 0 are the records, the highest level the archives' roots.

    ``start`` and ``stop`` bound a node's byte range. Records without a place are in no tree. The leaves are dealt by
    archive once; every level above is made where they lie.
    """
    dealt = leaves.where(F.col("archive").isNotNull()).repartition("archive")
    now = dealt.select(F.lit(0).alias("level"), "archive", F.col("slot").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), F.sha2(F.concat_ws(":", "slot", "length", "sha256"), 256).alias("hash"))
    out, level, width = now, 0, per_archive
    while width > 1:
        level, width = level + 1, -(-width // fan)
        child = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most ``fan``
        now = now.groupBy("archive", F.floor(F.col("node") / fan).cast("int").alias("up")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), child.alias("each"))
        now = now.select(F.lit(level).alias("level"), "archive", F.col("up").alias("node"), "start", "stop", F.sha2(F.array_join(F.transform("each", lambda e: F.concat_ws(":", e["node"], e["hash"])), ","), 256).alias("hash"))
        out = out.union(now)
    return out


def audit(primary: DataFrame, replica: DataFrame, fan: int = 16, per_archive: int = 4096) -> DataFrame:
    """Records that differ: ``archive, slot, offset, length, status, sha256, replica_sha256``.

    Both are ``records()`` or ``warc_records()``; they are written first, so their pages are read once. status: corrupt,
    missing (not in the replica), extra (only there, with its own offset and length), or unplaced: a record without a
    place that the other side has not, or not as often. Archives with equal roots are never opened below their root. Empty
    replicas make every record missing; equal replicas give no rows.
    """
    levels, width = 0, per_archive
    while width > 1:
        levels, width = levels + 1, -(-width // fan)
    sides = [written(r.select("archive", "slot", "offset", "length", "sha256"), f"records-{n}") for n, r in (("primary", primary), ("replica", replica))]
    both = [written(tree(r, fan, per_archive), "tree") for r in sides]
    differ = None
    for level in range(levels, -1, -1):
        a, b = (t.where(F.col("level") == level).select("archive", "node", "hash") for t in both)
        if differ is not None:
            parents = differ.select("archive", F.col("node").alias("parent"))
            a, b = (t.withColumn("parent", F.floor(F.col("node") / fan).cast("int")).join(parents, ["archive", "parent"], "left_semi").drop("parent") for t in (a, b))
        pair = a.withColumnRenamed("hash", "one").join(b.withColumnRenamed("hash", "two"), ["archive", "node"], "full")
        differ = written(pair.where("not (one <=> two)").select("archive", "node"), f"differ-{level}")
    keys = differ.withColumnRenamed("node", "slot")
    mine = sides[0].join(keys, ["archive", "slot"], "left_semi")
    other = sides[1].join(keys, ["archive", "slot"], "left_semi").select("archive", "slot", F.col("offset").alias("o"), F.col("length").alias("l"), F.col("sha256").alias("replica_sha256"))
    status = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("corrupt")
    placed = mine.join(other, ["archive", "slot"], "full").select("archive", "slot", F.coalesce("offset", "o").alias("offset"), F.coalesce("length", "l").alias("length"), status.alias("status"), "sha256", "replica_sha256")
    loose = [s.where(F.col("archive").isNull()).select("sha256", "length") for s in sides]
    alone = [x.join(y, ["sha256", "length"], "left_anti") for x, y in (loose, loose[::-1])]
    none = [F.lit(None).cast(primary.schema[c].dataType).alias(c) for c in ("archive", "slot", "offset")]
    return placed.union(alone[0].select(*none, "length", F.lit("unplaced"), "sha256", F.lit(None).cast("string"))).union(alone[1].select(*none, "length", F.lit("unplaced"), F.lit(None).cast("string"), "sha256"))
