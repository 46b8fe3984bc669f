"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are compared distinct, so exact copies cost one value. The trie is walked level by
level: Spark expands pairs of trie nodes over a few bits at a time, spending the budget of differing
bits and dropping a pair that exceeds it; once a pair of nodes holds few enough fingerprints, one task
walks the rest of both subtrees together. A node pair that is still large is expanded further, so a
hot prefix is divided and no task holds an unbounded group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, components, keyed, map_texts, written

BITS, STEP = 64, 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text; 0 if it has no words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter(map(_hash, parts), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):  # a very long text is counted in blocks
        block = h[at : at + 65536].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _hash(part: bytes, of=xxhash.xxh64_intdigest) -> int:
    return of(part, 42)


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(key, fp)`` for every row, fp the fingerprint as a signed long. Null and empty texts have 0."""

    def make():
        return lambda texts: [np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)]

    return map_texts(keyed(documents, key, text), [("fp", T.LongType())], make, key)


def masks(bits: int, budget: int) -> list[tuple[int, int]]:
    """All ways to differ in at most ``budget`` of ``bits`` bits: (mask, bits that differ)."""
    out = [(0, 0)]
    for i in range(bits):
        out += [(m | 1 << i, n + 1) for m, n in out if n < budget]
    return sorted(out)


def trie_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that differ in at most ``budget`` of the bits from ``depth`` on; left with itself if right is None.

    Both are distinct uint64 values in ascending order that agree on the first ``depth`` bits among
    themselves. A frontier of node pairs goes down one bit at a time; a node is a range of the sorted values.
    """
    same, right = right is None, left if right is None else right
    if not len(left) or not len(right):
        return left[:0], right[:0]
    frontier = np.array([[0, len(left), 0, len(right), budget]], np.int64)
    out_a, out_b = [], []
    for bit in range(BITS - 1 - depth, -2, -1):
        small = (frontier[:, 1] - frontier[:, 0]) * (frontier[:, 3] - frontier[:, 2]) <= 16 if bit >= 0 else np.ones(len(frontier), bool)
        leaf = frontier[small]
        if len(leaf):
            for i in range(int((leaf[:, 1] - leaf[:, 0]).max())):
                for j in range(int((leaf[:, 3] - leaf[:, 2]).max())):
                    a, b = leaf[:, 0] + i, leaf[:, 2] + j
                    ok = (a < leaf[:, 1]) & (b < leaf[:, 3]) & ((a < b) if same else True)
                    a, b = left[a[ok]], right[b[ok]]
                    near = np.bitwise_count((a ^ b) & np.uint64((1 << BITS - depth) - 1)) <= budget
                    out_a.append(a[near])
                    out_b.append(b[near])
        frontier = frontier[~small]
        if not len(frontier):
            break
        zeros = [np.concatenate([[0], np.cumsum((v >> np.uint64(bit) & np.uint64(1)) == 0)]) for v in (left, right)]
        l0, l1, r0, r1, rest = frontier.T
        lm, rm = l0 + zeros[0][l1] - zeros[0][l0], r0 + zeros[1][r1] - zeros[1][r0]
        kids = [(l0, lm, r0, rm, rest), (lm, l1, rm, r1, rest), (l0, lm, rm, r1, rest - 1), (lm, l1, r0, rm, rest - 1)]
        kids = [np.stack(k, 1) for k in kids]
        frontier = np.concatenate([k[(k[:, 0] < k[:, 1]) & (k[:, 2] < k[:, 3]) & (k[:, 4] >= 0)] for k in kids])
        if same:  # each unordered pair of nodes once
            frontier = frontier[frontier[:, 0] <= frontier[:, 2]]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (left[:0], right[:0])


def near_pairs(values: DataFrame, budget: int = 2, cell: int = 20_000) -> DataFrame:
    """Links ``(a, b)``, a <> b, of the distinct non-null longs in ``values(fp)`` at Hamming distance up to ``budget``.

    ``cell``: fingerprints that one task walks at most; larger node pairs are expanded by Spark.
    """
    values = written(values.where("fp is not null").select("fp").distinct(), "fingerprints")
    n = values.count()
    depth = STEP
    while depth < 24 and n >> depth > cell // 8:
        depth += STEP
    # Root pair expanded to ``depth``: children differ by a mask; the lesser prefix is the left side.
    pairs = _expand(values.select(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("used"), F.lit(0).alias("side"), "fp"), 0, depth, budget)
    # No pair can hold more than twice the fullest node's: as a rule that settles it without the pairs.
    fullest = values.groupBy(F.shiftrightunsigned("fp", BITS - depth).alias("p")).count().agg(F.max("count")).first()[0] or 0
    if 2 * fullest <= cell:
        return _walk(pairs, depth, budget)
    found, pairs = None, written(pairs, "nodes")
    while True:
        last = depth + STEP > BITS - 4
        heavy = pairs.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("p", "q")
        more = not last and not heavy.isEmpty()
        light = pairs.join(heavy, ["p", "q"], "left_anti") if more else pairs
        got = _walk(light, depth, budget)
        found = got if found is None else found.union(got)
        if not more:
            return found
        pairs = written(_expand(pairs.join(heavy, ["p", "q"], "left_semi"), depth, STEP, budget), "nodes")
        depth += STEP


def _expand(pairs: DataFrame, depth: int, bits: int, budget: int) -> DataFrame:
    """Children of the node pairs, ``bits`` further down, that are within the budget."""
    child = F.shiftright("fp", BITS - depth - bits).bitwiseAND(F.lit((1 << bits) - 1))
    steps = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(d).alias("d")) for m, d in masks(bits, budget)))
    rows = pairs.select("p", "q", "used", "side", "fp", child.alias("c"), F.explode(steps).alias("s")).where(F.col("used") + F.col("s.d") <= budget)
    mine, other = F.col("c"), F.col("c").bitwiseXOR(F.col("s.m"))
    down = lambda p, c: F.shiftleft(p, bits).bitwiseOR(c)
    equal = F.col("p") == F.col("q")
    # Within one node the pair of two children is kept once, the lesser child on the left.
    side = F.when(equal, F.when(mine <= other, 0).otherwise(1)).otherwise(F.col("side"))
    left, right = F.when(side == 0, mine).otherwise(other), F.when(side == 0, other).otherwise(mine)
    return rows.select(down(F.col("p"), left).alias("p"), down(F.col("q"), right).alias("q"), (F.col("used") + F.col("s.d")).alias("used"), side.alias("side"), "fp")


def _walk(pairs: DataFrame, depth: int, budget: int) -> DataFrame:
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        values, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        left, right = np.sort(values[side == 0]), np.sort(values[side == 1])
        itself = rows["p"].iat[0] == rows["q"].iat[0]
        a, b = trie_pairs(left, None if itself else right, depth, budget - int(rows["used"].iat[0]))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.groupBy("p", "q").applyInPandas(walk, "a long, b long")


def simhash_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row of ``documents``.

    fingerprint: 16 hex digits; component_id: the smallest key reachable over links, itself included.
    Null and empty texts have fingerprint zero and link like any other; repeated rows each get a row;
    null keys belong to their group but never name it; an empty table gives no rows.
    """
    prints = written(fingerprints(documents, key, text, shingle), "simhash")
    heads = prints.groupBy("fp").agg(F.min(f"`{key}`").alias("head"))
    roots = components(near_pairs(prints, budget))
    classes = heads.join(roots, heads.fp == roots.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    classes = written(classes, "classes")
    named = classes.groupBy("root").agg(F.min("head").alias("component_id")).join(classes.select("fp", "root"), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
