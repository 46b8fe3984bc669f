"""What must not leave: private values, field names and home paths in the cells of a published folder.

Private values are a table, as large as the data they come from. Nothing is compared pair by pair: of each value one
k-gram is chosen, the least by hash in a window, so that a text that holds the value has chosen that k-gram too. A Bloom
filter of the chosen k-grams, of a bounded size, goes to the executors, which read the folder once; a second one, of the
k-grams that were met, leaves few values. What passes both is joined by hash and then compared character by character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import written

#: Classes of values by least length: (length, characters of a k-gram, k-grams of a window). A window lies in any value of its class.
#: Long values have long k-grams: two of millions of ids hardly share one, as they would share eight characters.
CLASSES = ((1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (8, 8, 1), (16, 8, 9), (32, 16, 17), (64, 32, 33))
#: Bits of a Bloom filter, as a power of two: at least, at most (128 MB), and of the pieces (1 MB) that tasks make of it.
BITS = (16, 30, 23)
#: Characters that are hashed at once, so that their hashes stay in a core's cache.
_STEP = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HOME = re.compile(r"""(?:[A-Za-z]:\\Users\\|/home/|/Users/)[^\s"']+""", re.I)
_MET = "file string, column string, kind string, class int, hash long, at long, start long, text string"


def cells(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """``file, column, value``: every cell of the files in a published folder, named by its entry there; ``only``: those of columns of these names, in any case.

    Tables (``.csv`` and ``.tsv`` with a header, ``.parquet``) have cells by column, null ones none; of all other files each line is a cell of the column ``line``.
    An entry may be a file or a folder of part files.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    out = None
    for name in (n for n in names if not n.startswith(("_", "."))):
        at, kind = f"{folder.rstrip('/')}/{name}", name.rpartition(".")[2].lower()
        if kind in ("csv", "tsv"):
            table = spark.read.csv(at, header=True, sep="," if kind == "csv" else "\t", multiLine=True, escape='"', quote='"')
        elif kind == "parquet":
            table = spark.read.parquet(at)
        else:
            table = spark.read.text(at).withColumnRenamed("value", "line")
        columns = [c for c in table.columns if only is None or c.lower() in only]
        if not columns:
            continue
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
        found = table.select(F.lit(name).alias("file"), each.alias("c")).select("file", "c.column", "c.value").where("value IS NOT NULL")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.range(0).select(*(F.lit("").alias(c) for c in ("file", "column", "value")))


def _grams(text: str | np.ndarray, k: int, made: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """64-bit hashes, none of them 0, of all k-grams of code points, along the last axis; made of those of shorter ones, which ``made`` keeps."""
    made = {} if made is None else made
    if isinstance(text, str):
        text = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if k not in made:
        with np.errstate(over="ignore"):
            if k == 1:
                out = (text.astype(np.uint64) + np.uint64(1)) * _MIX
            else:
                half = 1 << ((k - 1).bit_length() - 1)
                one, two = _grams(text, half, made), _grams(text, k - half, made)
                n = max(text.shape[-1] - k + 1, 0)
                out = one[..., :n] * _MIX
                out += two[..., half : half + n]
            out ^= out >> np.uint64(29)
            out *= _MIX
            out |= np.uint64(1)
        made[k] = out
    return made[k]


def _sliding(best: Callable, numbers: np.ndarray, window: int) -> np.ndarray:
    """The best of each window of neighbours."""
    size = 1
    while 2 * size <= window:
        numbers, size = best(numbers[:-size], numbers[size:]), 2 * size
    rest = window - size
    return best(numbers[:-rest], numbers[rest:]) if rest else numbers


def _chosen(hashes: np.ndarray, window: int, starts: int | np.ndarray) -> np.ndarray:
    """Places of the least k-gram of the windows of neighbours that begin at ``starts`` (so many first places, or those with a true), the first of equal ones."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mask = starts[:n] if isinstance(starts, np.ndarray) else np.arange(n) < starts
    if window == 1:
        return np.flatnonzero(mask)
    padded = np.zeros(n + 2 * window - 1, np.uint64)
    least = padded[window - 1 :]
    np.multiply(_sliding(np.minimum, hashes, window), mask, out=least[:n])
    at = np.flatnonzero(_sliding(np.maximum, padded[:-1], window) == hashes)  # no window's least is larger than a k-gram in it
    again = np.flatnonzero((np.diff(hashes[at]) == 0) & (np.diff(at) < window)) + 1
    if len(again):  # such a one is the first only of windows that begin after its like
        between = np.maximum.reduceat(least, np.stack((at[again - 1] + 1, at[again] + 1), 1).ravel())[::2]
        at = np.delete(at, again[between != hashes[at[again]]])
    return at


def _texts(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist


def _joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one, its code points, and where each text ends."""
    whole = "".join(texts)
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


def _anchors(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, hash and offset of the chosen k-gram of each value's first window."""
    _, points, ends = _joined(values)
    sizes = np.diff(ends, prepend=0)
    places = np.searchsorted([c[0] for c in CLASSES], sizes, "right") - 1
    hashes, offsets = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64)
    for place in np.unique(places).tolist():
        _, k, window = CLASSES[place]
        reach = k + window - 1
        every = np.flatnonzero(places == place)
        for some in np.split(every, range(_STEP // reach, len(every), _STEP // reach)):
            found = _grams(points[(ends - sizes)[some][:, None] + np.arange(reach)], k)
            offsets[some] = found.argmin(axis=1)
            hashes[some] = found.min(axis=1)
    return places, hashes, offsets


def _hashes(values: DataFrame) -> DataFrame:
    """``hash``: of each value the chosen k-gram's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_anchors(_texts(batch.column(0)))[1].view(np.int64))], names=["hash"])

    return values.mapInArrow(run, "hash long")


def _anchored(values: DataFrame, bloom: np.ndarray) -> DataFrame:
    """``class, hash, offset, value``: the chosen k-gram of each value, if the filter holds it, and where that is."""
    shared = values.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, hashes, offsets = _anchors(_texts(batch.column(0)))
            at = np.flatnonzero(_passes(shared.value, hashes))
            arrays = [pa.array(places[at], pa.int32()), pa.array(hashes[at].view(np.int64)), pa.array(offsets[at], pa.int32()), batch.column(0).take(pa.array(at)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["class", "hash", "offset", "value"])

    return values.mapInArrow(run, "class int, hash long, offset int, value string")


def _bits(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash's word in a filter and two bits of it; the lowest bit of a hash tells nothing, and a chosen one's highest little."""
    return ((hashes >> np.uint64(1)) & np.uint64(words - 1)).astype(np.int64), (hashes >> np.uint64(40)) & np.uint64(63), (hashes >> np.uint64(50)) & np.uint64(63)


def _bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """A filter of about ``n`` different hashes; its pieces are made by tasks, so that the driver gets the filter and no more."""
    words = 1 << (min(max(BITS[0], int(12 * max(n, 1) - 1).bit_length()), BITS[1]) - 6)
    size = min(words, 1 << (BITS[2] - 6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            word, one, two = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), words)
            pieces = word // size
            for piece in np.unique(pieces).tolist():
                here = pieces == piece
                ones = made.setdefault(piece, np.zeros(size * 64, bool))
                for bit in (one, two):
                    ones[word[here] % size * 64 + bit[here].astype(np.int64)] = True
        for piece, ones in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(ones, bitorder="little").tobytes()], pa.binary())], names=["piece", "ones"])

    piece = F.shiftright(F.shiftright("hash", 1).bitwiseAND(F.lit(words - 1)), size.bit_length() - 1)
    out = np.zeros(words, np.uint64)
    for piece, ones in hashes.select("hash").repartition(words // size, piece).mapInArrow(run, "piece long, ones binary").collect():
        out[piece * size : (piece + 1) * size] = np.frombuffer(ones, np.uint64)
    return out


def _passes(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word, one, two = _bits(hashes, len(bloom))
    here = bloom[word]
    return (here >> one) & (here >> two) & np.uint64(1) == 1


def _met(points: np.ndarray, ends: np.ndarray, sizes: dict[int, tuple[int, int]], bloom: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Class, text, place in it and hash of the chosen k-grams that the filter holds."""
    reach = max(sum(CLASSES[place][1:]) for place in sizes)
    found: dict[int, list] = {place: [] for place in sizes}
    for begin in range(0, len(points), _STEP):
        stretch, made = points[begin : begin + _STEP + reach], {}
        stop = begin + len(stretch)
        here = ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, stop) + 1]
        left = np.repeat(here, np.diff(np.minimum(here, stop), prepend=begin)) - np.arange(begin, stop)
        for place, (least, _) in sizes.items():
            _, k, window = CLASSES[place]
            fits = left >= least  # a value that begins later would not fit
            fits[_STEP:] = False
            hashes = _grams(stretch, k, made)
            at = _chosen(hashes, window, fits)
            at = at[_passes(bloom, hashes[at])]
            found[place].append((begin + at, hashes[at]))
    for place, parts in found.items():
        if parts:
            at, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)  # the end of a stretch is the next one's beginning
            cell = np.searchsorted(ends, at, "right")
            yield place, cell, at - np.concatenate(([0], ends))[cell], np.concatenate([p[1] for p in parts])[first]


def _holding(texts: list[str], whole: str, ends: np.ndarray, parts: list[str]) -> list[int]:
    """Numbers of the texts that hold one of the parts, which are in small letters, whatever their own case; at times of others."""
    if not all(p and p.isascii() for p in parts):
        return list(range(len(texts)))
    low = whole.lower()
    if len(low) != len(whole):  # some capitals have two small letters
        return [i for i, t in enumerate(texts) if any(p in t.lower() for p in parts)]
    found = set()
    for part in parts:
        at = low.find(part)
        while at >= 0:
            cell = int(np.searchsorted(ends, at, "right"))
            found.add(cell)
            at = low.find(part, int(ends[cell]))
    return sorted(found)


def _scan(spread: DataFrame, names: list[str], sizes: dict[int, tuple[int, int]], bloom: np.ndarray | None) -> DataFrame:
    """``file, column, kind, class, hash, at, start, text``, of one reading: where a value may be, with what is around; cells that may give a field a value; home paths."""
    shared = spread.sparkSession.sparkContext.broadcast(bloom)
    low = [n.lower() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch, kind, cell, text, place=None, hashes=None, at=None, start=None):
            n, cell = len(text), pa.array(cell, pa.int64())
            longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (hashes, at, start)]
            arrays = [batch.column(0).take(cell), batch.column(1).take(cell), pa.array([kind] * n, pa.string()), pa.array([place] * n, pa.int32()), *longs, pa.array(text, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "column", "kind", "class", "hash", "at", "start", "text"])

        for batch in batches:
            texts = _texts(batch.column(2))
            whole, points, ends = _joined(texts)
            for place, cell, at, hashes in _met(points, ends, sizes, shared.value) if sizes else ():
                start, longest = np.maximum(at - CLASSES[place][2] + 1, 0), sizes[place][1]
                around = [texts[c][s : i + longest] for c, s, i in zip(cell.tolist(), start.tolist(), at.tolist(), strict=True)]
                yield rows(batch, "value", cell, around, place, hashes.view(np.int64), at, start)
            lines = _holding(texts, whole, ends, low) if low else []
            yield rows(batch, "field", lines, [texts[c] for c in lines])
            folders = _holding(texts, whole, ends, ["/home/", "users"]) if "\u017f" not in whole else range(len(texts))  # the pattern takes a long s for an s
            paths = [(c, m[0], m.start()) for c in folders for m in _HOME.finditer(texts[c])]
            yield rows(batch, "path", [c for c, _, _ in paths], [t for _, t, _ in paths], at=[i for _, _, i in paths])

    return spread.select("file", "column", "value").mapInArrow(run, _MET)


def _private_values(met: DataFrame, values: DataFrame) -> DataFrame:
    """``file, column, kind, value, offset``: each place (from 0, in characters) where a cell holds a value; as they are written, whatever their case."""
    near = met.where("kind = 'value'").drop("kind")
    wanted = _anchored(values, _bloom(near, near.agg(F.approx_count_distinct("hash")).first()[0])).dropDuplicates(["value"])
    begin = F.col("at") - F.col("offset")
    same = (begin >= F.col("start")) & (F.substring(F.col("text"), (begin - F.col("start") + 1).cast("int"), F.length("value")) == F.col("value"))
    return near.join(wanted, ["class", "hash"]).where(same).select("file", "column", F.lit("value").alias("kind"), "value", begin.alias("offset"))


def serialised_keys(line: Column, names: list[str]) -> Column:
    """Which of the names a line gives a value to, as JSON, YAML or settings do, unless that is false, null or none."""
    each = [F.when(F.lower(line).rlike(r"(?m)^\s*[\"']?" + re.escape(n.lower()) + r"[\"']?\s*[:=,]\s*(?!false\b|null\b|none\b)"), n) for n in names]
    return F.array_compact(F.array(*each))


def leaks(spark: SparkSession, folder: str, values: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``file, column, kind, value, offset`` of all that a published folder must not hold: private values, fields that are given one, home paths.

    The folder is read once, and again for columns of these names; the values are read three times. They
    are found wherever they stand in a cell, also twice or overlapping; a field has the offset null. An
    empty value is no value; a null cell is no cell; an empty folder has no leaks.
    """
    wanted = values.select(F.col(column).cast("string").alias("value")).where("length(value) > 0")
    lengths = wanted.groupBy(F.length("value").alias("size")).agg(F.approx_count_distinct("value").alias("n"))
    place = sum((F.col("size") >= least).cast("int") for least, _, _ in CLASSES) - 1
    found = lengths.groupBy(place.alias("class")).agg(F.min("size"), F.max("size"), F.sum("n")).collect()
    sizes = {r[0]: (r[1], r[2]) for r in found}
    bloom = _bloom(_hashes(wanted), sum(r[3] for r in found)) if sizes else None
    met = written(_scan(cells(spark, folder), names, sizes, bloom), "met")
    given = F.explode(serialised_keys(F.col("text"), names).cast("array<string>"))
    lines = met.where("kind = 'field'").select("file", "column", "kind", given.alias("value"), F.lit(None).cast("long").alias("offset"))
    headed = cells(spark, folder, [n.lower() for n in names]).select("file", "column", F.lit("field").alias("kind"), F.lower("column").alias("value"), F.lit(None).cast("long").alias("offset")).distinct()
    paths = met.where("kind = 'path'").select("file", "column", "kind", F.col("text").alias("value"), F.col("at").alias("offset"))
    out = lines.unionByName(headed).unionByName(paths)
    return out.unionByName(_private_values(met, wanted)) if sizes else out
