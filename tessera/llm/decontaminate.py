"""Benchmark decontamination with one Aho-Corasick automaton over normalised test passages.

The automaton reads word numbers, and its patterns are not all windows of an item, which would hold
each word ``width`` times, but the item cut into consecutive blocks of half a window: whatever
window occurs in a text, a whole block of it does. Where a block is met, the few windows around it are
looked up in a table of hashes and compared word by word, so that finds are exact.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, TEXT, keyed, rows_of, written

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space; UTF-8 bytes from 0x80 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> bytes:
    """Normalised text, byte for byte as long as its UTF-8 source, so that offsets are those of the source."""
    return (text or "").encode().translate(FOLD)


def runs(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of ``width`` word numbers."""
    out = np.full(max(0, len(ids) - width + 1), seed, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(31))) * _MIX + ids[j : j + len(out)].astype(np.uint64)
    return (out ^ (out >> np.uint64(32))) * _MIX


@dataclass
class Passages:
    """What a scan needs to know of the benchmark, as arrays; the automaton is built from it in each worker process."""

    width: int
    words: list[bytes]  # word number i is the i-1st of these, 0 is any other word
    ids: np.ndarray  # word numbers of the items, one after another
    blocks: np.ndarray  # where in ``ids`` a block begins
    short: list[tuple[int, int, list[str]]]  # items with fewer words than a window: (begin, end, their names)
    seed: int
    hashes: np.ndarray  # of the different windows, ascending
    at: np.ndarray  # where in ``ids`` a window begins that has this hash
    first: np.ndarray  # its items are owners[first[i] : first[i + 1]]
    owners: np.ndarray
    names: list[str]

    def letters(self) -> list[str]:
        """Two characters for each word number, the first from one alphabet and the second from another: no node of the automaton has many children."""
        base = math.isqrt(len(self.words)) + 1
        return ["\0\0", *(chr(1 + i // base) + chr(1 + base + i % base) for i in range(len(self.words)))]

    def automaton(self) -> tuple[ahocorasick.Automaton, int]:
        """Patterns: the blocks (value -1) and the short items (value: their place in ``short``; both: -2 less that); and the least pattern's words."""
        half, letters = (self.width + 1) // 2, self.letters()
        spell = lambda a, b: "".join([letters[i] for i in self.ids[a:b].tolist()])
        value = {spell(b, b + half): (half, -1) for b in self.blocks.tolist()}
        for i, (a, b, _) in enumerate(self.short):
            pattern = spell(a, b)
            value[pattern] = (b - a, -2 - i if pattern in value else i)
        found = ahocorasick.Automaton()
        for pattern, v in value.items():
            found.add_word(pattern, v)
        if value:
            found.make_automaton()
        return found, min((n for n, _ in value.values()), default=0)


def passages(items: list[tuple[str, str]], width: int = 13) -> Passages:
    """From (name, text) pairs; items without words have no windows."""
    number: dict[bytes, int] = {}
    ids, blocks, starts, owner, short, at = [], [], [], [], {}, 0
    half, names = (width + 1) // 2, sorted({n for n, _ in items})
    place = {n: i for i, n in enumerate(names)}
    for name, text in items:
        own = [number.setdefault(w, len(number) + 1) for w in fold(text).split()]
        if len(own) >= width:
            blocks += range(at, at + len(own) - half + 1, half)
            starts += range(at, at + len(own) - width + 1)
            owner += [place[name]] * (len(own) - width + 1)
        elif own:
            short.setdefault(tuple(own), (at, at + len(own), set()))[2].add(name)
        ids += own
        at += len(own)
    ids, starts, owner = np.array(ids, np.uint32), np.array(starts, np.int64), np.array(owner, np.int64)
    seed = 0
    while True:
        h = runs(ids, width, seed)[starts] if len(starts) else np.zeros(0, np.uint64)
        order = np.lexsort((owner, h))
        h, begin, who = h[order], starts[order], owner[order]
        same = np.flatnonzero(h[1:] == h[:-1])
        # Windows of one hash must be one window; if a clash is met, another seed is taken.
        if all((ids[begin[same] + j] == ids[begin[same + 1] + j]).all() for j in range(width)):
            break
        seed += 1
    new = np.r_[len(h) > 0, (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    fresh = new.copy()
    fresh[1:] |= who[1:] != who[:-1]
    who, new = who[fresh], new[fresh]
    lead = np.flatnonzero(new)
    keep = np.flatnonzero(fresh)[lead]
    return Passages(width, list(number), ids, np.array(blocks, np.int64), [(a, b, sorted(n)) for a, b, n in short.values()], seed, h[keep], begin[keep], np.append(lead, len(who)), who, names)


class Scanner:
    """Finds the occurrences of windows in texts; one for each worker process."""

    def __init__(self, known: Passages):
        self.known, (self.machine, least) = known, known.automaton()
        self.number = {w: i + 1 for i, w in enumerate(known.words)}
        self.letters = dict(zip(known.words, known.letters()[1:], strict=True))
        self.half = (known.width + 1) // 2
        #: Words in a row that the benchmark has, as many as a pattern or more.
        self.stretch = re.compile(f"[^\0]{{{2 * least},}}")

    def ranges(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of word numbers in which a window occurs, merged, ends exclusive; and the items found."""
        if not len(self.machine):
            return [], set()
        get = self.letters.get
        spelled = "".join([get(w, "\0\0") for w in words])
        known, near, found, items = self.known, set(), [], set()
        for m in self.stretch.finditer(spelled):
            for last, (size, v) in self.machine.iter(spelled, *m.span()):
                start = (last + 1) // 2 - size
                i = v if v >= 0 else -2 - v
                if v < 0:
                    near.add(start)
                if i >= 0:
                    found.append((start, start + size))
                    items.update(known.short[i][2])
        if near:
            number = self.number.get
            ids, w = np.array([number(x, 0) for x in words], np.uint32), known.width
            # A block stands at most a window less its own length behind the beginning of a window.
            at = np.unique(np.array(sorted(near))[:, None] - np.arange(w - self.half + 1))
            at = at[(at >= 0) & (at + w <= len(ids))]
            if len(at) and len(known.hashes):
                parts = ids[at[:, None] + np.arange(w)]
                h = np.full(len(at), known.seed, np.uint64)
                for j in range(w):
                    h = (h ^ (h >> np.uint64(31))) * _MIX + parts[:, j].astype(np.uint64)
                h = (h ^ (h >> np.uint64(32))) * _MIX
                i = np.minimum(np.searchsorted(known.hashes, h), len(known.hashes) - 1)
                ok = (known.hashes[i] == h) & (parts == known.ids[known.at[i][:, None] + np.arange(w)]).all(axis=1)
                found += [(int(a), int(a) + w) for a in at[ok]]
                for k in np.unique(i[ok]).tolist():
                    items.update(known.names[o] for o in known.owners[known.first[k] : known.first[k + 1]].tolist())
        return merge(found), items


def merge(ranges: list) -> list[tuple[int, int]]:
    """Sorted, and joined where they meet or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def source_spans(text: str, words: list[bytes], ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges of word numbers as code points of the source."""
    folded, raw = fold(text), text.encode()
    out, place, chars, upto, at = [], 0, 0, 0, 0
    for a, b in ranges:
        pair = []
        while at < b:
            start = folded.index(words[at], place)
            place = start + len(words[at])
            if at == a:
                chars, upto = chars + len(raw[upto:start].decode()), start
                pair.append(chars)
            at += 1
        chars, upto = chars + len(raw[upto:place].decode()), place
        out.append([*pair, chars])
    return out


_HELD: dict[str, Scanner] = {}


def _scanner(name: str, shared) -> Scanner:
    """The scanner of this name, built once in a worker process, which keeps one."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Scanner(shared.value)
    return _HELD[name]


#: Stands for a null item id; named items have a mark before their id.
UNNAMED = "-"


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, share: float = 0.05, most_bytes: int = 8 << 20) -> DataFrame:
    """For every document: ``key, n_words, n_hit, items array<string>, spans array<array<int>>, contaminated``.

    A document is contaminated if at least ``share`` of its words, and at least one, lie in an
    occurrence of a benchmark window. ``spans`` are code-point ranges of the source text. Null and
    empty texts have no words and are clean; items without words never occur; the words of an item without id are hit, but it isn't listed; an empty benchmark
    leaves all documents clean; repeated rows each get a row.

    The benchmark's size is summed first. Up to ``most_bytes`` of its text make one automaton (at some
    20 times the text's size in each worker process) and the documents are read once. A larger one is dealt by item into as many
    parts as it takes; for each the documents are read again, and what is found so far is written in between.
    """
    items = benchmark.where(F.col(f"`{item_text}`").isNotNull()).select(F.coalesce(F.concat(F.lit("="), F.col(f"`{item}`").cast("string")), F.lit(UNNAMED)).alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // most_bytes))
    limit = Fraction(str(share))
    empty = F.array()
    docs = keyed(documents, key, text).select(KEY, TEXT, empty.cast("array<array<int>>").alias("ranges"), empty.cast("array<string>").alias("items"))
    fields = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("spans", "array<array<int>>"), ("contaminated", "boolean")]
    closing = T.StructType([T.StructField(key, docs.schema[KEY].dataType), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        shared = documents.sparkSession.sparkContext.broadcast(passages([tuple(r) for r in own.collect()], width))  # bounded above
        name = uuid.uuid4().hex
        if part < parts - 1:
            docs = written(docs.mapInArrow(_search(name, shared), docs.schema), "passages")
    return docs.mapInArrow(_judge(name, shared, limit, key), closing)


def _found(scanner: Scanner, words: list[bytes], ranges: list, items: list) -> tuple[list[tuple[int, int]], list[str]]:
    more, names = scanner.ranges(words)
    return merge([*ranges, *more]) if ranges else more, sorted({*items, *(n[1:] for n in names if n != UNNAMED)})


def _search(name: str, shared):
    def run(batches):
        scanner = _scanner(name, shared)
        for batch in batches:
            got = [_found(scanner, fold(x).split(), ranges, items) for x, ranges, items in rows_of(batch, TEXT, "ranges", "items")]
            columns = [pa.array([[list(r) for r in g[0]] for g in got], pa.list_(pa.list_(pa.int32()))), pa.array([g[1] for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column(TEXT), *columns], names=[KEY, TEXT, "ranges", "items"])

    return run


def _judge(name: str, shared, limit: Fraction, key: str):
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.bool_())

    def run(batches):
        scanner = _scanner(name, shared)
        for batch in batches:
            out = [[], [], [], [], []]
            for x, ranges, items in rows_of(batch, TEXT, "ranges", "items"):
                words = fold(x).split()
                ranges, items = _found(scanner, words, ranges, items)
                hit = sum(b - a for a, b in ranges)
                row = (len(words), hit, items, source_spans(x, words, ranges) if ranges else [], hit > 0 and hit * limit.denominator >= len(words) * limit.numerator)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(KEY), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=[key, "n_words", "n_hit", "items", "spans", "contaminated"])

    return run
