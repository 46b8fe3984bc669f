"""Near-duplicate embeddings by an exact metric range join.

On unit vectors cosine >= t is distance <= r = sqrt(2 - 2 t). Pivots partition the vectors into
cells. A vector can have a partner in another cell only if it is within r of the plane between the
two pivots, and, by the triangle inequality, no further from the other pivot than that cell's
radius plus r; only there it is replicated, and only to the cell that comes later, so
each pair is compared in one place. Cells join independently; within one, vectors are ordered by their
distance from the pivot, and stretches of them whose distances differ by more than r are not compared. A cell
beyond ``BLOCK`` vectors joins in blocks. There is a pivot for every ``CELL`` vectors or more; how many more
pay is estimated on a bounded sample: in data without clusters the bounds exclude little.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: Vectors for which there is one pivot at least; and vectors of one block of a cell: a task compares two blocks.
CELL, BLOCK = 8192, 8192
#: Single precision decides outside this band around the threshold, double precision within it.
BAND = 1e-4


def unit(vectors, width: int) -> np.ndarray:
    """Rows of length one in double precision, filled up with zeros to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        v = np.asarray(v, np.float64)
        out[i, : len(v)] = v / np.abs(v).max()
    return out / np.linalg.norm(out, axis=1)[:, None]


def choose_pivots(sample: np.ndarray, n: int, r: float, most: int) -> np.ndarray:
    """As many rows of the sample as make the estimated work of joining ``n`` vectors least; one for ``CELL`` vectors, and eight, at least."""
    best, cost = None, math.inf
    k = max(1, min(max(8, -(-n // CELL)), len(sample) // 2, most))
    while best is None or k <= min(most, len(sample) // 8, max(1, n // 64)):
        near = sample @ sample[:k].T
        home = near.argmax(axis=1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * sample[:k] @ sample[:k].T))
        sent = (near[np.arange(len(sample)), home][:, None] - near <= r * gap[home]) & (np.arange(k) > home[:, None])
        size = np.bincount(home, minlength=k) / len(sample)
        pairs = n * n * float((size * size / 2 + size * sent.mean(axis=0)).sum())
        blocks = max(1.0, n * float(size.max()) / BLOCK)
        rows = n * (blocks + float(sent.sum(axis=1).mean()) * blocks)
        now = pairs * 1e-8 + rows * 2e-5 + n * k * 1e-7
        if now < cost:
            best, cost = sample[:k], now
        k *= 2
    return best


def place(x: np.ndarray, pivots: np.ndarray, r: float, radius: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, its distance from the pivot, and the (rows, cells) that it is replicated to."""
    near = x @ pivots.T
    home = near.argmax(axis=1)
    own = near[np.arange(len(x)), home]
    gap = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    sent = (own[:, None] - near <= r * gap[home] + 1e-9) & (np.arange(len(pivots)) > home[:, None])
    if radius is not None:
        sent &= np.sqrt(np.maximum(0, 2 - 2 * near)) <= radius + r + 1e-9
    return home, np.sqrt(np.maximum(0, 2 - 2 * own)), sent


def link_blocks(a: np.ndarray, b: np.ndarray | None, dims_a, dims_b, weight_a, weight_b, threshold: float, far_a=None, far_b=None):
    """Linked weight of each row of ``a`` and of ``b`` (one block with itself if b is None), and edges (i, j) that keep their connections.

    ``far_a``, ``far_b``: distances from one pivot, in ascending order; stretches that they tell apart are not compared.
    """
    same = b is None
    if same:
        b, dims_b, weight_b, far_b = a, dims_a, weight_a, far_a
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    sum_a, sum_b, edges = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
    for i in range(0, len(a), 1024):
        for j in range(0, len(b), 2048):
            if same and j + 2048 <= i:
                continue
            if far_a is not None:
                p, q = far_a[i : i + 1024], far_b[j : j + 2048]
                if p[0] - q[-1] > reach or q[0] - p[-1] > reach:
                    continue
            s = fa[i : i + 1024] @ fb[j : j + 2048].T
            hit = s >= threshold - BAND
            if not hit.any():
                continue
            p, q = np.nonzero(hit & (s < threshold + BAND))
            if len(p):
                hit[p, q] = np.einsum("ij,ij->i", a[i + p], b[j + q]) >= threshold
            hit &= dims_a[i : i + 1024, None] == dims_b[None, j : j + 2048]
            if same:
                hit &= np.arange(i, i + hit.shape[0])[:, None] < np.arange(j, j + hit.shape[1])[None, :]
            sum_a[i : i + 1024] += hit @ weight_b[j : j + 2048]
            sum_b[j : j + 2048] += weight_a[i : i + 1024] @ hit
            if (n := int(hit.sum())) <= 4 * sum(hit.shape):
                if n:
                    p, q = np.nonzero(hit)
                    edges.append(np.stack([i + p, j + q], 1))
            else:  # dense: a tree in place of all pairs
                edges.append(_tree(hit) + np.array([i, j]))
    if same:
        sum_a = sum_b = sum_a + sum_b
    return sum_a, sum_b, np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _tree(hit: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of a dense bipartite block, grown breadth first with whole rows at a time."""
    rows, cols = np.ones(hit.shape[0], bool), np.ones(hit.shape[1], bool)
    out = []
    for start in range(hit.shape[0]):
        if not rows[start] or not hit[start].any():
            continue
        rows[start] = False
        front = [start]
        while front:
            at = front.pop()
            new = np.nonzero(hit[at] & cols)[0]
            cols[new] = False
            out += [(at, c) for c in new.tolist()]
            for c in new.tolist():
                more = np.nonzero(hit[:, c] & rows)[0]
                rows[more] = False
                out += [(m, c) for m in more.tolist()]
                front += more.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def embedding_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, most_pivots: int = 1024, sample: int = 4096) -> DataFrame:
    """For every row: ``key, n_links, component_id, kept``.

    Rows link if their vectors' cosine is at least ``threshold`` (over 0), in double precision; vectors of
    different lengths don't link. n_links counts other rows, copies included; component_id is the
    smallest key reachable; kept marks the row that names its component. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null key, link with nothing (a null key
    gives a null component and is kept). Equal vectors are compared once. Rows that share a key
    count as one node. ``sample`` bounds the vectors from which pivots are chosen.
    """
    v = F.col(f"`{vector}`")
    real = F.col("x").isNotNull()
    usable = v.isNotNull() & F.col(f"`{key}`").isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = vectors.select(F.col(f"`{key}`").alias("k"), F.when(usable, v).alias("x"))
    rows = rows.select("k", "x", F.when(real, F.xxhash64("x")).alias("h1"), F.when(real, F.xxhash64(F.lit("second"), "x")).alias("h2"))
    classes = written(rows.where(real).groupBy("h1", "h2").agg(F.min("k").alias("node"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x")), "vectors")
    total, width = classes.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    numbered = rows.select("k", "h1", "h2")
    if not total:
        return numbered.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    r = math.sqrt(max(0.0, 2 - 2 * threshold))
    drawn = unit([s["x"] for s in classes.orderBy("h1", "h2").limit(sample).select("x").collect()], width)
    pivots = choose_pivots(drawn, total, r, most_pivots)
    node = classes.schema["node"].dataType.simpleString()

    def measure(batches):
        for d in batches:
            home, far, sent = place(unit(d["x"], width), pivots, r, None)
            cells = np.arange(len(pivots))
            reach = np.zeros(len(pivots))
            np.maximum.at(reach, home, far)
            yield pd.DataFrame({"cell": cells, "home": np.bincount(home, minlength=len(pivots)), "guests": sent.sum(axis=0), "radius": reach})

    sizes = classes.select("x").mapInPandas(measure, "cell int, home long, guests long, radius double").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("guests").alias("guests"), F.max("radius").alias("radius"))
    got = {s["cell"]: s for s in sizes.collect()}  # a row for each pivot
    parts = np.array([-(-got[c]["home"] // BLOCK) if c in got else 0 for c in range(len(pivots))])
    guest_parts = np.array([-(-got[c]["guests"] // BLOCK) if c in got else 0 for c in range(len(pivots))])
    radius = np.array([got[c]["radius"] if c in got else 0.0 for c in range(len(pivots))])
    held = classes.sparkSession.sparkContext.broadcast((pivots, parts, guest_parts, radius))

    def deal(batches):
        pivots, parts, guest_parts, radius = held.value
        for d in batches:
            home, _, sent = place(unit(d["x"], width), pivots, r, radius)
            salt = (d["h1"].to_numpy().view(np.uint64) >> np.uint64(7)).astype(np.int64)
            out = []  # (row, cell, kind, left block, right block, side)
            for i, h in enumerate(home.tolist()):
                own = int(salt[i] % max(1, parts[h]))
                for j in range(int(parts[h])):
                    out.append((i, h, 0, min(own, j), max(own, j), int(own > j)))
                for g in range(int(guest_parts[h])):
                    out.append((i, h, 1, g, own, 1))
                for q in np.nonzero(sent[i])[0].tolist():
                    g = int(salt[i] % max(1, guest_parts[q]))
                    out += [(i, q, 1, g, j, 0) for j in range(int(parts[q]))]
            at = np.array(out, np.int64)
            for s in range(0, len(at), 20_000):
                a = at[s : s + 20_000]
                part = d.iloc[a[:, 0]][["node", "n", "x"]].reset_index(drop=True)
                yield pd.DataFrame({"cell": a[:, 1], "kind": a[:, 2], "i": a[:, 3], "j": a[:, 4], "side": a[:, 5], **part})

    element = classes.schema["x"].dataType.simpleString()
    dealt = classes.select("node", "n", "h1", "x").mapInPandas(deal, f"cell int, kind int, i int, j int, side int, node {node}, n long, x {element}")

    def join(d: pd.DataFrame) -> pd.DataFrame:
        sides = [d] if d["kind"].iat[0] == 0 and d["i"].iat[0] == d["j"].iat[0] else [d[d["side"] == 0], d[d["side"] == 1]]
        units = [unit(s["x"], width) for s in sides]
        pivot = held.value[0][int(d["cell"].iat[0])]
        far = [np.sqrt(np.maximum(0, 2 - 2 * (u @ pivot))) for u in units]
        order = [np.argsort(x, kind="stable") for x in far]
        sides, units, far = ([x.iloc[o] if isinstance(x, pd.DataFrame) else x[o] for x, o in zip(part, order, strict=True)] for part in (sides, units, far))
        dims = [s["x"].map(len).to_numpy() for s in sides]
        nodes, weights = [s["node"].to_numpy() for s in sides], [s["n"].to_numpy() for s in sides]
        if len(sides) == 1:
            sums, _, edges = link_blocks(units[0], None, dims[0], None, weights[0], None, threshold, far[0])
            counted = [(nodes[0], sums)]
        else:
            left, right, edges = link_blocks(units[0], units[1], dims[0], dims[1], weights[0], weights[1], threshold, far[0], far[1])
            counted = [(nodes[0], left), (nodes[1], right)]
        frames = [pd.DataFrame({"a": n[s > 0], "b": n[s > 0], "w": s[s > 0]}) for n, s in counted]
        frames.append(pd.DataFrame({"a": nodes[0][edges[:, 0]], "b": nodes[-1][edges[:, 1]], "w": np.zeros(len(edges), np.int64)}))
        return pd.concat(frames, ignore_index=True)

    found = written(dealt.groupBy("cell", "kind", "i", "j").applyInPandas(join, f"a {node}, b {node}, w long"), "links")
    counts = found.where("w > 0").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    roots = components(found.where("w = 0").select("a", "b"), "vector-components").withColumnRenamed("node", "member")
    named = classes.select("h1", "h2", "node", "n").join(counts, "node", "left").join(roots, F.col("node") == F.col("member"), "left")
    named = named.select("h1", "h2", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = numbered.where("h1 is not null").join(named, ["h1", "h2"]).select("k", "n_links", "component_id")
    alone = numbered.where("h1 is null").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return out.union(alone).select(F.col("k").alias(key), "n_links", "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"))
