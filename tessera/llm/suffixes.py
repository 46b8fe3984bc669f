"""Repeated passages across documents by sparse suffix arrays.

Of all suffixes only those that start at a minimiser are kept: the least hash among ``window``
consecutive k-grams of words. Any passage of ``k + window - 1`` words has one, and equal passages have
the same. Suffixes are grouped by their first k-gram; where it occurs in different texts they are
sorted by what follows, and neighbours are extended word by word to the right and to the left. Within a
group they are also taken in the order of what stands before. Where that leaves a suffix with less than its
whole reach, its group is sorted once for each place the suffix can have in a passage, which finds the
partners that are neighbours in neither order. Passages of ``least`` words or more count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, TEXT, keyed, rows_of, written
from .decontaminate import fold

_SEED = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each normalised word of the whole text."""
    words = fold(text).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _SEED + h[j : j + len(out)]
    return (out ^ (out >> np.uint64(32))) * _SEED


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the first of equal ones) in each window of k-grams."""
    if not len(grams):
        return np.zeros(0, np.int64)
    width = min(window, len(grams))
    seen = []
    for at in range(0, len(grams) - width + 1, 1 << 16):  # a long text in pieces that overlap by a window
        part = grams[at : at + (1 << 16) + width - 1]
        seen.append(np.unique(np.lib.stride_tricks.sliding_window_view(part, width).argmin(axis=1) + np.arange(at, at + len(part) - width + 1)))
    return np.unique(np.concatenate(seen))


def context(h: np.ndarray, at: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the hashes of the ``reach`` words after the k-gram and before it, nearest first.

    Past an end stands a value that no other text has there: extension stops.
    """
    short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # never zero
    pad = np.concatenate([np.zeros(reach, np.uint32), short, np.zeros(reach, np.uint32)])
    base = at[:, None] + reach
    steps = np.arange(reach)
    return pad[base + k + steps], pad[base - 1 - steps]


def common_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values of the rows are equal and not an end."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _extend(key, right, left, doc, order, k, least) -> Iterator[tuple]:
    """Suffixes with what they share, before and after the k-gram, with the nearest one before and behind in this order that another text holds."""
    key, doc = key[order], doc[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    runs = np.nonzero(fresh)[0]
    run = np.cumsum(fresh) - 1
    before = np.where(run > 0, runs[run] - 1, -1)  # last of the run before
    ends = np.append(runs[1:], len(order))
    after = np.where(ends[run] < len(order), ends[run], -1)  # first of the run behind
    for other in (before, after):
        i = np.nonzero(other >= 0)[0]
        j = other[i]
        same = key[i] == key[j]
        a, b = order[i[same]], order[j[same]]
        r, l = common_run(right[a], right[b]), common_run(left[a], left[b])  # noqa: E741
        ok = r + l + k >= least
        for side in (a, b):
            yield side[ok], l[ok], r[ok]


def _windows(gram, right, left, k, least) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix and each number of words before it, a hash of the ``least`` words from there; and whether all of them are in the text."""
    shifts = least - k + 1
    ahead, behind = (np.zeros((shifts, len(gram)), np.uint64) for _ in range(2))
    for side, out in ((right, ahead), (left, behind)):
        for j in range(1, shifts):
            out[j] = (out[j - 1] ^ (out[j - 1] >> np.uint64(29))) * _SEED + side[:, j - 1]
    whole = [np.cumprod(side[:, : shifts - 1] != 0, axis=1).sum(axis=1) for side in (right, left)]
    h = gram.astype(np.int64).view(np.uint64) + ahead[::-1] * _SEED
    h = (h ^ (h >> np.uint64(31))) * _SEED + behind
    h = (h ^ (h >> np.uint64(30))) * _SEED + np.arange(shifts, dtype=np.uint64)[:, None]
    steps = np.arange(shifts)[:, None]
    return (h ^ (h >> np.uint64(32))).view(np.int64), (steps <= whole[1]) & (shifts - 1 - steps <= whole[0])


def repeated_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50, k: int = 16, window: int = 32) -> DataFrame:
    """``key, n_words, n_repeat, spans array<array<int>>`` of each document that shares a passage of ``least`` words or more with another one.

    Words are runs of letters and digits, A-Z lower-cased; spans are merged ranges of word numbers, ends
    exclusive. Equal texts of that many words are repeated whole. Documents without such a passage, null,
    empty and shorter ones, have no row. Repeats within one text alone don't count. Rows
    that repeat a key each get a row; a table without rows gives none. ``k + window - 1 <= least`` is required.
    """
    if k + window - 1 > least:
        raise ValueError("k + window - 1 must not exceed least")
    docs = keyed(documents, key, text)
    # Past the last minimiser of a passage up to window - 1 words follow its k-gram, as many stand before the first one.
    reach = max(window, least - k)
    digest = F.unhex(F.md5(F.col(TEXT)))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, lists = [], [], []
            for i, (x,) in enumerate(rows_of(batch, TEXT)):
                h = word_hashes(x)
                if len(h) >= least:
                    g = kgrams(h, k)
                    # A k-gram that the text repeats is told once: where it stands, is found again below.
                    lists.append(np.unique(g[minimisers(g, window)]).view(np.int64))
                    rows.append(i)
                    sizes.append(len(h))
            if rows:
                ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                grams = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([batch.column(KEY).take(pa.array(rows)), batch.column("digest").take(pa.array(rows)), pa.array(sizes, pa.int64()), grams], names=["k", "digest", "n_words", "grams"])

    # The texts are hashed once; what is needed of them to find shared k-grams is small, and written.
    kept = docs.where(F.col(TEXT).isNotNull()).select(KEY, digest.alias("digest"), TEXT)
    fields = [T.StructField("k", docs.schema[KEY].dataType), T.StructField("digest", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))]
    own = written(kept.mapInArrow(starts, T.StructType(fields)), "grams")
    grams = own.select("digest", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("gram")
    listed = grams.join(shared, "gram", "left_semi").groupBy("digest").agg(F.collect_set("gram").alias("grams"))  # bounded by the text
    texts = docs.where(F.col(TEXT).isNotNull()).select(digest.alias("digest"), TEXT).dropDuplicates(["digest"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, x, wanted in rows_of(batch, "digest", TEXT, "grams"):
                h = word_hashes(x)
                g = kgrams(h, k)
                at = minimisers(g, window)
                at = at[np.isin(g[at], np.array(wanted, np.int64).view(np.uint64))]
                for s in range(0, len(at), 8192):
                    part = at[s : s + 8192]
                    right, left = context(h, part, k, reach)
                    cells = [[r.tobytes() for r in side.astype(">u4")] for side in (right, left)]
                    yield pa.RecordBatch.from_arrays([pa.array(g[part].view(np.int64)), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary()), pa.array([d] * len(part), pa.binary()), pa.array(part.astype(np.int32))], names=["gram", "right", "left", "digest", "pos"])

    array = written(texts.join(listed, "digest").mapInArrow(suffixes, "gram long, right binary, left binary, digest binary, pos int"), "suffixes")
    order = ["gram", "right", "digest", "pos"]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _compare(batch, k, least, reach)

    # Dealt by more than the k-gram, so that a very frequent one is spread over tasks; by few bytes, for the driver gets a sample of them.
    sorted_rows = array.select(*order, "left").repartitionByRange("gram", F.substring("right", 1, 16), "digest", "pos").sortWithinPartitions(*order)
    found = written(sorted_rows.mapInArrow(neighbours, "digest binary, start int, stop int, pos int, passage long"), "neighbours")
    # Groups that a batch may hold in part: what is in one text of a batch and in another one elsewhere.
    apart = found.where("passage is not null")
    met = apart.groupBy("passage").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("passage")
    late = apart.where("start is not null").join(met, "passage", "left_semi").groupBy("digest", "pos").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = _merged(found.where("passage is null").select("digest", "start", "stop").union(late.select("digest", "start", "stop")))
    copies = own.groupBy("digest").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max("n_words").alias("w")).where("low <> high").select("digest", F.array(F.array(F.lit(0), F.col("w").cast("int"))).alias("whole"))
    both = copies.join(spans, "digest", "full").select("digest", F.coalesce("whole", "spans").alias("spans"))
    out = own.join(both, "digest")
    return out.select(F.col("k").alias(key), "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0]).alias("n_repeat"), "spans")


def _merged(found: DataFrame) -> DataFrame:
    """``digest, spans``: ranges [start, stop) of each text sorted and joined where they meet; a window over one text's ranges."""
    order = Window.partitionBy("digest").orderBy("start", "stop")
    rows = found.select("digest", "start", "stop").withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.count_if(F.coalesce(F.col("start") > F.col("reach"), F.lit(True))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("digest", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return parts.groupBy("digest").agg(F.array_sort(F.collect_list(F.array("start", "stop"))).alias("spans"))


def _compare(batch: pa.RecordBatch, k: int, least: int, reach: int) -> Iterator[pa.RecordBatch]:
    """Spans of the suffixes of one sorted batch; and, of its first and last k-gram, whose groups may go on outside, passages to be met elsewhere."""
    gram, pos = batch.column("gram").to_numpy(), batch.column("pos").to_numpy().astype(np.int64)
    # Digests are compared as Python values: as array elements they would lose trailing zero bytes.
    texts = batch.column("digest").to_pylist()
    doc = pd.factorize(np.array(texts, object))[0]
    left_bytes = batch.column("left").to_pylist()
    right, left = (np.frombuffer(b"".join(c), ">u4").reshape(-1, reach).astype(np.uint32) for c in (batch.column("right").to_pylist(), left_bytes))
    # Backward order: by k-gram, then by the words before it, nearest first.
    text = np.empty(len(gram), object)
    text[:] = left_bytes
    backward = np.lexsort((pos, doc, pd.factorize(text, sort=True)[0], gram))
    rows, settled = [], np.zeros(len(gram), bool)
    for order in (np.arange(len(gram)), backward):
        for i, l, r in _extend(gram, right, left, doc, order, k, least):  # noqa: E741
            rows.append((i, pos[i] - l, pos[i] + k + r))
            settled[i[(l == reach) & (r == reach)]] = True
    edge = (gram == gram[0]) | (gram == gram[-1])
    at = np.nonzero(edge | np.isin(gram, gram[~settled]))[0]
    h, inside = _windows(gram[at], right[at], left[at], k, least)
    shift, i = np.nonzero(inside)
    h, i, start = h[shift, i], at[i], pos[at[i]] - shift
    order = np.lexsort((doc[i], h))
    h, i, start = h[order], i[order], start[order]
    change = h[1:] != h[:-1]
    first, last = np.flatnonzero(np.r_[len(h) > 0, change]), np.flatnonzero(np.r_[change, len(h) > 0])
    met = doc[i[first]] != doc[i[last]]
    common = np.repeat(met, last - first + 1)
    rows.append((i[common], start[common], start[common] + least))
    sides = np.stack([np.concatenate(part).astype(np.int64) for part in zip(*rows, strict=True)], 1)
    if len(sides):
        # All spans of a suffix hold its k-gram, so that they are one.
        who, back = np.unique(sides[:, 0], return_inverse=True)
        low, high = np.full(len(who), np.iinfo(np.int64).max), np.zeros(len(who), np.int64)
        np.minimum.at(low, back, sides[:, 1])
        np.maximum.at(high, back, sides[:, 2])
        yield _found([texts[x] for x in who], low, high, pos[who], None)
    # Of a passage that several texts of the batch share, two of them tell the others of it. Rows without a
    # start only tell: what their suffix shares is all known here.
    tells = ~common
    tells[first[met]] = tells[last[met]] = True
    tells &= edge[i]
    if tells.any():
        known = (common | settled[i])[tells]
        yield _found([texts[x] for x in i[tells]], start[tells], start[tells] + least, pos[i[tells]], h[tells], known)


def _found(digests: list, start: np.ndarray, stop: np.ndarray, pos: np.ndarray, passage: np.ndarray | None, known: np.ndarray | None = None) -> pa.RecordBatch:
    ints = [pa.array(x, pa.int32(), mask=known) for x in (start, stop)]
    last = pa.nulls(len(digests), pa.int64()) if passage is None else pa.array(passage, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *ints, pa.array(pos, pa.int32()), last], names=["digest", "start", "stop", "pos", "passage"])
