"""Periodic run detection: power-of-two naming of words (Karp, Miller and Rosenberg), squares looked for on grids of their period.

The words of a text are named so that equal words have equal names; then, level by level, each block of 2^k
words gets the rank of its pair of half blocks. Two stretches of words are compared by the names of their
blocks alone, exactly, without hashes and without sorting suffixes.

A run of period q that is at least 4q long holds three whole blocks of q words that begin at multiples of q. So for each
period only the n/q multiples of it are candidates; all periods between two powers of two are looked at together,
which makes n log n candidates and no Python loop over words or periods. What the names leave is extended to both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, TEXT, keyed, map_texts

#: A run repeats its period at least so often, and has at least so many words.
REPEATS, LEAST = 4, 6

FIELDS = [
    ("n_words", T.LongType()), ("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()),
    ("runs", T.ArrayType(T.ArrayType(T.LongType()))), ("collapsed", T.StringType()),
]


class Names:
    """Names of the blocks of 1, 2, 4, … words of one text, as far as any block of that size comes twice."""

    def __init__(self, words: np.ndarray):
        self.n, self.levels = len(words), [words.astype(np.int32)]
        self.alike = len(np.unique(words)) < self.n

    def grow(self) -> bool:
        """One more level; False if no two of its blocks are equal, so that none larger are, or if the text is too short for a run of such blocks."""
        below, size = self.levels[-1], 1 << len(self.levels)
        if not self.alike or REPEATS * size > self.n:
            return False
        pairs = below[: self.n - size + 1].astype(np.int64) * self.n + below[size >> 1 :][: self.n - size + 1]
        kinds, names = np.unique(pairs, return_inverse=True)
        self.alike = len(kinds) < len(pairs)
        self.levels.append(names.astype(np.int32))
        return self.alike

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
        """Whether the stretches of ``length`` words, 2^k <= length <= 2^(k + 1), at a and at b are equal: two blocks that overlap cover them."""
        names, rest = self.levels[k], length - (1 << k)
        return (names[a] == names[b]) & (names[a + rest] == names[b + rest])

    def common(self, a: np.ndarray, b: np.ndarray, k: int, forwards: bool) -> np.ndarray:
        """How many words from a < b on (or before them) are equal, up to 2^(k + 1) - 1: levels from k down, each tried once."""
        got = np.zeros(len(a), np.int64)
        for level in range(k, -1, -1):
            names, size = self.levels[level], 1 << level
            x, y = (a + got, b + got) if forwards else (a - got - size, b - got - size)
            inside = (y + size <= self.n) if forwards else (x >= 0)
            same = inside & (names[np.where(inside, x, 0)] == names[np.where(inside, y, 0)])
            got += size * same
        return got


def runs(words: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text whose words are given as numbers below their count, by start, then period.

    A run is a maximal stretch whose smallest period is q, of max(6, 4q) words or more. ``most`` bounds
    how many candidates are held at once; it changes no result.
    """
    names, found, k = Names(words), [], 0
    n = names.n
    while names.alike and REPEATS << k <= n:
        last = min((2 << k) - 1, n // REPEATS)
        q = 1 << k
        while q <= last:
            # Periods q..upto together: about n / q candidates each, as far as the bound allows.
            upto = min(last, q + max(0, most * q // n))
            found.append(_of_periods(names, k, np.arange(q, upto + 1)))
            q = upto + 1
        k += 1
        if not names.grow():
            break
    if not found:
        return np.empty((0, 3), np.int64)
    every = np.concatenate(found)
    # A stretch is found once more for each multiple of its period: the least one names it.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _of_periods(names: Names, k: int, periods: np.ndarray) -> np.ndarray:
    """Stretches (start, length, period) for the periods given, all of them from 2^k up to 2^(k + 1) - 1."""
    n = names.n
    counts = (n - 3 * periods) // periods + 1  # grid points with three whole blocks behind them
    q = np.repeat(periods, counts)
    at = (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * q
    hit = names.equal(at, at + q, q, k)
    at, q = at[hit], q[hit]
    hit = names.equal(at + q, at + 2 * q, q, k)
    at, q = at[hit], q[hit]
    if not len(at):
        return np.empty((0, 3), np.int64)
    # Neighbours on the grid of one period lie in one stretch: a chain's ends are extended by less than a period.
    opens = np.ones(len(at), bool)
    opens[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + q[1:])
    heads, tails = at[opens], at[np.append(np.flatnonzero(opens)[1:] - 1, len(at) - 1)]
    q = q[opens]
    start = heads - names.common(heads, heads + q, k, False)
    end = tails + 3 * q
    end = end + names.common(end - q, end, k, True)
    long = end - start >= np.maximum(LEAST, REPEATS * q)
    return np.stack([start, end - start, q], axis=1)[long]


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence among different words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which words stay if each run is cut to its first period: those in no run behind its first ``period`` words."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def planted(words: list[bytes], number: int) -> list[bytes]:
    """The words with a repeat made from ``number``: where it is a multiple of 10, all from a on repeat the p words there."""
    n, g = len(words), number // 10
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _rows(texts: Iterable[str | None], numbers: Iterable[int | None]) -> list[list]:
    out: list[list] = [[] for _ in FIELDS]
    for text, number in zip(texts, numbers, strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if number is not None:
            words = planted(words, number)
        found = runs(numbered(words))
        best = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=[None] * 3)
        stay = kept_words(len(words), found)
        collapsed = b" ".join(w for w, s in zip(words, stay, strict=True) if s).decode("utf-8", "surrogatepass")
        for column, value in zip(out, [len(words), len(found), *best, found.tolist(), collapsed], strict=True):
            column.append(value)
    return out


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: ``key, n_words, n_runs, start, length, period, runs, collapsed``.

    Words are the stretches without ASCII white space. ``runs`` lists [start, length, period] in words; start, length and
    period alone are of the longest run (then the first, then that of least period), null without runs. ``collapsed`` is the
    text with each run cut to its first period and words joined by a space. Rows are treated one by one: equal
    rows give equal results, a null or empty text has no words and no runs, and other columns, whatever their names, are not read.
    A text is held whole, with 4 bytes a word for each level that has equal blocks: some 7 levels in prose, log2(n / 4) where half a text repeats.
    """
    return map_texts(keyed(docs, key, text), FIELDS, lambda: lambda texts: _rows(texts, [None] * len(texts)), key)


def planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``periodic_runs`` after ``planted`` with the CRC-32 of the key as its number (a null key plants none), and with
    ``runs_sha256`` (of ``start,length,period`` and a line feed a run) and ``collapsed_sha256`` in place of runs and collapsed."""
    df = keyed(docs, key, text)
    rows = df.select(KEY, TEXT, F.crc32(F.col(KEY).cast("string").cast("binary")).alias("number"))
    names = [key, "n_words", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256"]
    schema = T.StructType([T.StructField(key, df.schema[KEY].dataType), *(T.StructField(c, T.LongType()) for c in names[1:6]), *(T.StructField(c, T.StringType()) for c in names[6:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *numbers, every, collapsed = _rows(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                listed = ["".join(f"{a},{b},{c}\n" for a, b, c in found) for found in every]
                digests = [pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in column], pa.string()) for column in (listed, collapsed)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in numbers), *digests], names=names)

    return rows.mapInArrow(run, schema)
