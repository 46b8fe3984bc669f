"""Readers of the engine's file formats, each with an explicit schema."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.checks import Violation, duplicates, require
from .sinks import uri, written

SENTENCES = "corpus_id string, doc_path string, sent_idx int, sent_text string, sent_id string"
SCORES = "sent_id string, score double"
FEATURES = (
    "corpus_id string, sent_id string, tfidf_mean_nonzero double, tfidf_max double, technical_token_ratio double, identifier_density double, "
    "command_path_flag_density double, version_numeric_density double, assignment_parameter_density double, token_shape_complexity_mean double, token_count int, char_count int"
)


def first_of(df: DataFrame, *names: str) -> Column:
    """The first non-null of those of the named columns that exist."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    if not found:
        raise Violation(f"none of the columns {names} is there")
    return F.coalesce(*found)


def documents(spark: SparkSession, root: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """``doc_path, content`` of the files under root that match a glob and no exclusion; each file once.

    ``**`` crosses folders, ``*`` does not; undecodable bytes are dropped. Names that begin with a dot or underscore are passed over.
    Folders are listed by the executors and their files dealt out by name, thousands to a task, so the driver holds none. Where
    only Spark opens the root (a store of its own, a pattern), its binary files are read.
    """
    kept = F.lit(False)
    for g in include:
        kept = kept | F.col("doc_path").rlike(_glob(g))
    for g in exclude:
        kept = kept & ~F.col("doc_path").rlike(_glob(g))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    at = _opened(spark, root)
    if at:
        return _contents(_listed(spark, at).where(kept), at).select("doc_path", text.alias("content"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").rsplit("://", 1)[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base if base.startswith("/") else f"/{base}") + "/", "")
    return files.select(path.alias("doc_path"), text.alias("content")).where(kept)


def _opened(spark: SparkSession, root: str) -> str | None:
    """The address of a folder as Spark resolves it, if Arrow opens it too."""
    from pyarrow import fs

    if re.search(r"[*?\[\]{}]", root):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        at = uri(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
        system, base = fs.FileSystem.from_uri(at)
        return at if system.get_file_info(base).type == fs.FileType.Directory else None
    except Exception:  # whatever stands against it, Spark's own reader says it better
        return None


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``doc_path, size`` of all files below root, a level of folders after the other; a folder is one task's, as stores list it in one go."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [i for i in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))) if not re.match(r"\.|_[^=]*$", i.base_name)]
                for k in range(0, len(found), _NAMES):
                    some = found[k : k + _NAMES]
                    names = [f"{folder}/{i.base_name}".lstrip("/") for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i.size if i.is_file else None for i in some], pa.int64())], names=["doc_path", "size"])

    folders, levels = spark.createDataFrame([("",)], "folder string"), []
    while not levels or not folders.isEmpty():
        level = written(folders.mapInArrow(run, "doc_path string, size long"), "listing")
        levels.append(level.where("size IS NOT NULL"))
        folders = level.where("size IS NULL").select(F.col("doc_path").alias("folder")).repartition(spark.sparkContext.defaultParallelism, "folder")
    return reduce(DataFrame.unionByName, levels)


#: Names in a batch of a listing and in a task that reads; bytes in such a task, and in a batch of what it has read.
_NAMES, _TASK, _BATCH = 5_000, 64 << 20, 8 << 20


def _contents(files: DataFrame, root: str) -> DataFrame:
    """``doc_path, content`` of listed files."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, n // _NAMES + 1, size // _TASK + 1)

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        batch_of = lambda names, bodies: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["doc_path", "content"])
        for batch in batches:
            names, bodies, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{name}") as f:
                    bodies.append(f.read())
                names.append(name)
                held += len(bodies[-1])
                if held > _BATCH:
                    yield batch_of(names, bodies)
                    names, bodies, held = [], [], 0
            if names:
                yield batch_of(names, bodies)

    return files.select("doc_path").repartition(tasks, "doc_path").mapInArrow(run, "doc_path string, content binary")


def _glob(pattern: str) -> str:
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def csv(spark: SparkSession, path: str, schema: str, bom: bool = False) -> DataFrame:
    """A CSV artifact with a header and quoted fields that may hold line ends. ``bom``: the first column's name has a mark."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", bom).csv(path)
    return df


def scores(spark: SparkSession, path: str, duplicate: str = "raise") -> DataFrame:
    """A header-less ``sent_id<TAB>score`` file; ``duplicate``: raise, or keep the last score of an id, in the order of files and lines."""
    df = spark.read.schema(SCORES).option("sep", "\t").option("mode", "FAILFAST").csv(path)
    if duplicate == "raise":
        require(duplicates(df, "sent_id"), "duplicate ids")
        return df
    # Lines of one split are numbered as they are read; splits are ordered by file and offset.
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return df.select("sent_id", "score", line.alias("line")).groupBy("sent_id").agg(F.max_by("score", "line").alias("score"))


def sniffed_scores(spark: SparkSession, path: str, prefer: tuple[str, ...] = ("score", "prediction")) -> DataFrame:
    """``sent_id, score`` of a TSV with or without a header and with ragged rows.

    The score column is the preferred name, else the only column that is numeric in every row; ambiguity raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], SCORES)
    head = first[0].split("\t")
    named = not any(_number(h) for h in head)
    parts = F.split("value", "\t")
    rows = lines.select(parts.alias("p")).where(F.array_join("p", "\t") != first[0]) if named else lines.select(parts.alias("p"))
    width = rows.agg(F.max(F.size("p"))).first()[0] or len(head)
    names = [h.strip().lower() for h in head] if named else [f"c{i}" for i in range(width)]
    cell = lambda i: F.try_element_at("p", F.lit(i + 1))
    chosen = next((names.index(n) for n in prefer if n in names), None)
    if chosen is None:
        numeric = rows.agg(*(F.bool_and(cell(i).try_cast("double").isNotNull()).alias(f"n{i}") for i in range(width))).first()
        found = [i for i in range(width) if numeric[i]]
        if len(found) != 1:
            raise Violation(f"no single numeric column: {found}")
        chosen = found[0]
    key = names.index("sent_id") if "sent_id" in names else 0
    return rows.select(cell(key).alias("sent_id"), cell(chosen).try_cast("double").alias("score"))


def _number(s: str) -> bool:
    try:
        float(s)
    except ValueError:
        return False
    return True


def keyed_scores(all_scores: DataFrame, keys: DataFrame, key: str = "sent_id") -> DataFrame:
    """Only the wanted ids; raises if one of them is missing or has several rows."""
    wanted = keys.select(key).distinct()
    got = all_scores.join(wanted, key, "left_semi")
    require(duplicates(got, key), "duplicate wanted ids")
    require(wanted.join(got, key, "left_anti"), "missing wanted ids")
    return got


def jsonl(spark: SparkSession, path: str, schema: str, key: tuple[str, ...] = ()) -> DataFrame:
    """One object a line, with unique keys if ``key`` is given."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key:
        require(duplicates(df, *key), "duplicate keys")
    return df


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of lines like ``tensor(0.12)`` or ``0.12``; raises for one that is no number in [0, 1]."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    v = F.regexp_extract("value", r"^\s*(?:tensor\()?([-+0-9.eE]+)\)?\s*$", 1).try_cast("double")
    df = raw.select(F.col("value").alias("line"), v.alias("value"))
    require(df.where(F.col("value").isNull() | ~F.col("value").between(0, 1)).select("line"), "not a number in [0, 1]")
    return df.select("value")


def wiki_pages(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``doc_path, title, content`` of the first n articles of a dump: namespace 0, no redirect, with a title and a text.

    First is what comes first in the shards by name, and within a shard where it stands: pages are numbered by shard, split and place. Shards
    are counted from the first on, twice as many each time, until they have n articles; those behind are not read.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(root) or []
    files, folders = [], list(found)
    while folders:
        for status in system.listStatus(folders.pop().getPath()):
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                (folders if status.isDirectory() else files).append(status)
    shards = sorted({s.getPath().toString() for s in files})
    schema = "id long, ns int, title string, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"

    def articles(names: list[str]) -> DataFrame:
        pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(names)
        body, title = F.btrim(F.coalesce("revision.text._VALUE", F.lit("")), F.lit(_WHITE)), F.btrim(F.coalesce("title", F.lit("")), F.lit(_WHITE))
        place = (F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
        return pages.select(*place, "ns", "redirect", title.alias("title"), body.alias("content")).where((F.col("ns") == 0) & F.col("redirect").isNull() & (F.col("title") != "") & (F.col("content") != ""))

    upto = total = 0
    while upto < len(shards) and total < n:
        more = shards[upto : 2 * upto + 1]
        total += articles(more).count()
        upto += len(more)
    if not upto:
        return spark.createDataFrame([], "doc_path string, title string, content string")
    order = ["shard", "split", "place"]
    first = articles(shards[:upto]).orderBy(*order).limit(n)
    i = F.row_number().over(Window.orderBy(*order))  # n rows
    return first.select(F.concat(F.format_string("%04d_", i), slug(F.col("title")), F.lit(".txt")).alias("doc_path"), "title", "content")


_WHITE = " \t\n\r\f\v"


def annotated_name(path: Column) -> tuple[Column, Column]:
    """(corpus, annotator) from a file name like corpus_spot_check_x__name.csv; null if it has another form."""
    part = lambda i: F.nullif(F.regexp_extract(path, r"([^/]+?)_spot_check_[^/]*__([^/.]+)\.csv$", i), F.lit(""))
    return part(1), part(2)


def xlsx(content: bytes, sheet: int = 1) -> dict[str, str]:
    """Cells of a small workbook by their reference; read on the driver from the zipped parts."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        out = {}
        for c in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:c", ns):
            value = c.find("m:v", ns)
            if c.get("t") == "inlineStr":
                out[c.get("r")] = "".join(t.text or "" for t in c.iterfind(".//m:t", ns))
            elif value is not None:
                out[c.get("r")] = shared[int(value.text)] if c.get("t") == "s" else value.text or ""
        return out


def changed_cells(released: dict[str, str], returned: dict[str, str], open_columns: tuple[str, ...]) -> list[str]:
    """Cells outside the columns meant to be filled in that a returned workbook changed, added or lost, the header included."""
    fixed = {at for at in released.keys() | returned.keys() if at == at.rstrip("0123456789") + "1" or at.rstrip("0123456789") not in open_columns}
    return sorted(at for at in fixed if released.get(at) != returned.get(at))


def sheet(cells: dict[str, str]) -> list[dict[str, str | None]]:
    """Rows of a sheet by the names in its first line."""
    grid: dict[int, dict[str, str]] = {}
    for at, value in cells.items():
        column = at.rstrip("0123456789")
        grid.setdefault(int(at[len(column) :]), {})[column] = value
    header = grid.pop(1, {})
    return [{name: row.get(column) for column, name in header.items()} for _, row in sorted(grid.items())]


def archive_member(content: bytes, name: str) -> bytes:
    """One file of a tar.gz or zip; raises for unsafe names anywhere in it."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            check_names([(i.filename, (i.external_attr >> 16) & 0o170000 == 0o120000) for i in z.infolist()])
            return z.read(name)
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        check_names([(m.name, m.issym() or m.islnk()) for m in t.getmembers()])
        return t.extractfile(name).read()


def check_names(members: list[tuple[str, bool]]) -> None:
    """No absolute or climbing path, no link, no two names that differ by case only."""
    seen = set()
    for name, link in members:
        parts = name.replace("\\", "/").split("/")
        if link or name.startswith(("/", "\\")) or ".." in parts or re.match(r"^[A-Za-z]:", name) or name.lower() in seen:
            raise Violation(f"unsafe archive member: {name}")
        seen.add(name.lower())


def manifest(text: str) -> list[dict]:
    """Corpora of a small YAML manifest: a list of flat mappings whose values are scalars or lists of scalars."""
    out: list[dict] = []
    held = None
    for raw in text.splitlines():
        line = re.sub(r"\s+#.*$", "", raw).rstrip()
        if not line.strip() or line.strip().startswith("#") or line.strip() == "corpora:":
            continue
        body = line.strip()
        if m := re.match(r"-\s+([A-Za-z_]\w*):\s*(.*)$", body):
            out.append({})
            body = f"{m[1]}: {m[2]}".strip()
        if body.startswith("- "):
            held.append(_scalar(body[2:]))
        elif m := re.match(r"([A-Za-z_]\w*):\s*(.*)$", body):
            value = m[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[-1][m[1]] = [_scalar(v) for v in value[1:-1].split(",") if v.strip()]
            elif value:
                out[-1][m[1]] = _scalar(value)
            else:
                held = out[-1].setdefault(m[1], [])
    return out


def _scalar(s: str) -> str:
    return s.strip().strip("\"'")
