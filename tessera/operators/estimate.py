"""Correlation, deterministic bootstraps, standardisation and cluster-robust regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, percentile
from ..sources.sinks import written
from .order import average_ranks, cumulative, quantiles, ranges, ranks_within, row_number, spread


def spearman(df: DataFrame, x: str, y: str, by: list[str], empty: float | None = 0.0) -> DataFrame:
    """``by..., n, rho``: correlation of average ranks; ``empty`` where a side is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(both, {x: "__x", y: "__y"}, by)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(correlation(F.col("__x"), F.col("__y")), F.lit(empty)).alias("rho"))


def draws(units: DataFrame, key: str, by: list[str], reps: int, seed: str = "7") -> DataFrame:
    """``rep, by..., key, w``: how often each unit is drawn in each of ``reps`` resamples of its group, units with 0 left out.

    Units are numbered by the hash of their key. Draw j of replicate r takes unit floor(u n), u from the digest
    of seed:floor(r / 8):group:j, of which each of eight replicates takes 32 bits: an exact multinomial draw, the same wherever and
    whenever it is made. Of a replicate's draws only the counts are shuffled.
    """
    numbered = row_number(units.select(*by, key), [key], by, "j", key=F.col(key).cast("string"))
    group = [F.col(b).cast("string") for b in by]
    eight = numbered.select(*by, "total", "j", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // 8))).alias("block"))
    eight = eight.withColumn("digest", F.sha2(F.concat_ws(":", F.lit(seed), F.col("block").cast("string"), *group, F.col("j").cast("string")), 256))
    made = eight.select(*by, "total", "block", "digest", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part")).withColumn("rep", F.col("block") * 8 + F.col("part")).where(F.col("rep") < reps)
    u = F.conv(F.substring(F.col("digest"), F.col("part") * 8 + 1, F.lit(8)), 16, 10).cast("long") / F.lit(4294967296.0)
    picks = made.select("rep", *by, F.floor(u * F.col("total")).alias("j"))
    weights = picks.groupBy("rep", *by, "j").agg(F.count(F.lit(1)).alias("w"))
    return weights.join(numbered.select(*by, key, "j"), [*by, "j"]).select("rep", *by, key, "w")


#: Draws that one task weighs at once: a cell has so many units over the number of replicates, 65,536 at most.
_CELL = 1 << 22


def resampled_sums(units: DataFrame, key: str, by: list[str], columns: list[str], reps: int, seed: str = "7") -> DataFrame:
    """``rep, by..., columns``: the sums of the units' columns over each of ``reps`` resamples, whose draws are those of ``draws``.

    Units are numbered and cut into cells. A draw is not a row: those that a batch of digests makes for one cell are shuffled as one array of four
    bytes each, and meet the cell's units once. A null in a column counts as 0.
    """
    width = max(256, min(1 << 16, _CELL // reps))
    packed = "<u4" if reps <= 1 << 16 else "<u8"
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    numbered = written(row_number(units.select(*by, key, *values), [key], by, "j", key=F.col(key).cast("string")).drop(key).withColumn("cell", F.floor(F.col("j") / width)), "units")
    group = [F.col(b).cast("string") for b in by]
    blocks = numbered.select(*by, "total", "j", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // 8))).alias("block"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), F.col("block").cast("string"), *group, F.col("j").cast("string")), 256))
    blocks = blocks.select(*by, "total", "block", digest.alias("digest"))
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in numbered.select(*by).schema)
    size = len(by)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = np.zeros(n, np.int64)
            for column in batch.columns[:size]:
                known = column.dictionary_encode()
                codes = codes * len(known.dictionary) + known.indices.to_numpy(zero_copy_only=False)
            total, block, digests = (c for c in batch.columns[size:])
            words = np.frombuffer(b"".join(digests.to_pylist()), ">u4").reshape(n, 8)
            unit = np.floor(words / 4294967296.0 * total.to_numpy()[:, None]).astype(np.int64).ravel()
            rep = (block.to_numpy().astype(np.int64)[:, None] * 8 + np.arange(8)).ravel()
            _, first, kind = np.unique(codes, return_index=True, return_inverse=True)
            kept = rep < reps
            unit, rep, kind = unit[kept], rep[kept], np.repeat(kind, 8)[kept]
            slot = kind * (unit.max() // width + 1) + unit // width
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            picks = (rep << 16 | unit % width)[order].astype(packed)
            rows = pa.array(first[kind[order[starts]]])
            cells = pa.array((unit // width)[order[starts]], pa.int64())
            arrays = pa.array([x.tobytes() for x in np.split(picks, starts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:size]), cells, arrays], names=[*by, "cell", "picks"])

    def weigh(cell: pa.Table, dealt: pa.Table) -> pa.Table:
        drawn = np.frombuffer(b"".join(dealt["picks"].to_pylist()), packed).astype(np.int64)
        rep, at = drawn >> 16, drawn & 0xFFFF
        place = cell["j"].to_numpy() % width
        seen = np.flatnonzero(np.bincount(rep, minlength=reps))
        sums = []
        for c in columns:
            worth = np.zeros(width)
            worth[place] = cell[c].to_numpy()
            sums.append(pa.array(np.bincount(rep, worth[at], reps)[seen]))
        same = pa.array(np.zeros(len(seen), np.int64))
        return pa.Table.from_arrays([pa.array(seen, pa.int32()), *(cell[b].take(same) for b in by), *sums], names=["rep", *by, *columns])

    dealt = blocks.mapInArrow(deal, f"{own}cell long, picks binary")
    parts = numbered.groupBy(*by, "cell").cogroup(dealt.groupBy(*by, "cell")).applyInArrow(weigh, f"rep int, {own}{', '.join(f'`{c}` double' for c in columns)}")
    return parts.groupBy("rep", *by).agg(*(F.sum(c).alias(c) for c in columns))


def interval(replicates: DataFrame, value: str, by: list[str], least_valid: float = 0.0) -> DataFrame:
    """``by..., valid, low, high``: the 2.5 and 97.5 % points of the valid replicates; null if too few are valid."""
    got = replicates.groupBy(*by).agg(F.count(value).alias("valid"), F.count(F.lit(1)).alias("reps"), percentile(F.col(value), 0.025).alias("low"), percentile(F.col(value), 0.975).alias("high"))
    enough = F.col("valid") >= least_valid * F.col("reps")
    return got.select(*by, "valid", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def cluster_means(rows: DataFrame, value: str, cluster: str, by: list[str], reps: int, seed: str = "7") -> DataFrame:
    """``rep, by..., mean``: ratio of weighted sums over resampled clusters; only sums by cluster meet the weights."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    return resampled_sums(sums, cluster, by, ["s", "c"], reps, seed).select("rep", *by, F.try_divide("s", "c").alias("mean"))


def cluster_medians(rows: DataFrame, value: str, cluster: str, by: list[str], reps: int, seed: str = "7", buckets: int | None = None) -> DataFrame:
    """``rep, by..., median``: the median of the values, each as often as its cluster was drawn.

    All replicates share ranges of values. Sums by range say which one or two ranges hold a replicate's middle; only their values are
    weighed one by one, so no task sorts a replicate's values. ``buckets``: how many ranges, by default as ``spread`` says.
    """
    buckets = spread(rows) if buckets is None else buckets
    counts = ranges(rows.where(F.col(value).isNotNull()), value, by, buckets).groupBy(*by, cluster, "range", value).agg(F.count(F.lit(1)).alias("c"))
    counts = written(counts, "counts")
    drawn = written(draws(rows.select(*by, cluster).distinct(), cluster, by, reps, seed), "draws")
    sizes = counts.groupBy(*by, cluster, "range").agg(F.sum("c").alias("c"))
    sums = drawn.join(sizes, [*by, cluster]).groupBy("rep", *by, "range").agg(F.sum(F.col("w") * F.col("c")).alias("n"))
    order = Window.partitionBy("rep", *by).orderBy("range")  # ``buckets`` rows at most
    upto, whole = F.sum("n").over(order), F.sum("n").over(Window.partitionBy("rep", *by))
    sums = sums.select("rep", *by, "range", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.floor((whole - 1) / 2).alias("low"), F.floor(whole / 2).alias("high"))
    holds = lambda p: (F.col(p) >= F.col("before")) & (F.col(p) < F.col("upto"))
    middle = written(sums.where(holds("low") | holds("high")).drop("upto"), "middle")
    # A row or two for each replicate of a group: joined by their keys, all values of a range that many replicates share would meet in one task.
    near = counts.join(F.broadcast(middle), [*by, "range"]).join(drawn, ["rep", *by, cluster]).groupBy("rep", *by, "range", "before", "low", "high", value).agg(F.sum(F.col("w") * F.col("c")).alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("rep", *by, "range").orderBy(value))
    run = near.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    at = lambda p: F.max(F.when(holds(p), F.col(value)))
    return run.groupBy("rep", *by).agg(((at("low") + at("high")) / 2).alias("median"))


def cluster_rank_correlations(rows: DataFrame, x: str, y: str, cluster: str, by: list[str], reps: int, seed: str = "7") -> DataFrame:
    """``rep, by..., rho`` with ranks fixed at the full sample: six sums by cluster carry all that a replicate needs."""
    ranked = average_ranks(rows, {x: "a", y: "b"}, by)
    a, b = F.col("a"), F.col("b")
    sums = ranked.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))
    total = resampled_sums(sums, cluster, by, ["n", "sa", "sb", "aa", "bb", "ab"], reps, seed)
    n = F.col("n")
    over = F.sqrt(F.greatest(F.lit(0.0), n * F.col("aa") - F.col("sa") ** 2)) * F.sqrt(F.greatest(F.lit(0.0), n * F.col("bb") - F.col("sb") ** 2))
    return total.select("rep", *by, F.try_divide(n * F.col("ab") - F.col("sa") * F.col("sb"), over).alias("rho"))


def joint_correlations(rows: DataFrame, x: str, y: str, key: str, by: list[str], reps: int, seed: str = "7") -> DataFrame:
    """``rep, by..., rho`` with rows resampled and ranked anew in each replicate; for small samples. Null where degenerate."""
    drawn = draws(rows, key, by, reps, seed).join(rows.select(*by, key, x, y), [*by, key]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    ranked = drawn.withColumn("a", ranks_within(F.col(x), "rep", *by)).withColumn("b", ranks_within(F.col(y), "rep", *by))
    return ranked.groupBy("rep", *by).agg(correlation(F.col("a"), F.col("b")).alias("rho"))


def contrasts(replicates: DataFrame, value: str, over: str, reference: str, by: list[str]) -> DataFrame:
    """``rep, by..., over, difference``: each other level minus the reference on the same replicate."""
    base = replicates.where(F.col(over) == reference).select("rep", *by, F.col(value).alias("base"))
    return replicates.where(F.col(over) != reference).join(base, ["rep", *by]).select("rep", *by, over, (F.col(value) - F.col("base")).alias("difference"))


def common_support(rows: DataFrame, stratum: str, corpus: str = "corpus_id", doc: str = "doc_path", least_rows: int = 100, least_docs: int = 20) -> DataFrame:
    """``corpus, stratum, n, documents, share, reference, weight`` of strata that are full enough in every corpus.

    reference: the mean of the corpora's shares, made to sum to 1; weight: reference over the corpus' own share.
    """
    cells = rows.groupBy(corpus, stratum).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(doc).alias("documents"))
    corpora = rows.agg(F.countDistinct(corpus).alias("corpora"))
    good = cells.where((F.col("n") >= least_rows) & (F.col("documents") >= least_docs)).groupBy(stratum).agg(F.count(F.lit(1)).alias("has")).crossJoin(F.broadcast(corpora)).where("has = corpora").select(stratum)
    held = cells.join(good, stratum)
    held = held.join(F.broadcast(held.groupBy(corpus).agg(F.sum("n").alias("all"))), corpus).withColumn("share", F.col("n") / F.col("all"))
    reference = held.groupBy(stratum).agg(F.avg("share").alias("raw"))
    reference = reference.crossJoin(F.broadcast(reference.agg(F.sum("raw").alias("sum")))).select(stratum, (F.col("raw") / F.col("sum")).alias("reference"))
    return held.join(F.broadcast(reference), stratum).select(corpus, stratum, "n", "documents", "share", "reference", (F.col("reference") / F.col("share")).alias("weight"))


def standardised(rows: DataFrame, value: str, stratum: str, support: DataFrame, corpus: str = "corpus_id") -> DataFrame:
    """``corpus, n, mean, standardised_mean, ess``: from sums by stratum; ess is (sum w)^2 / sum w^2."""
    sums = rows.groupBy(corpus, stratum).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    j = sums.join(support.select(corpus, stratum, "weight"), [corpus, stratum])
    w, c = F.col("weight"), F.col("c")
    return j.groupBy(corpus).agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"), (F.sum(w * F.col("s")) / F.sum(w * c)).alias("standardised_mean"), (F.sum(w * c) ** 2 / F.sum(w * w * c)).alias("ess"))


def standardised_replicates(rows: DataFrame, value: str, stratum: str, support: DataFrame, cluster: str, reps: int, seed: str = "7", corpus: str = "corpus_id") -> DataFrame:
    """``rep, corpus, mean``: stratum means of resampled clusters under the fixed reference; null where a stratum is empty."""
    held = rows.join(support.select(corpus, stratum, "reference"), [corpus, stratum])
    sums = held.groupBy(corpus, cluster, stratum, "reference").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    strata = support.groupBy(corpus).agg(F.count(F.lit(1)).alias("strata"))
    per = draws(sums.select(corpus, cluster).distinct(), cluster, [corpus], reps, seed).join(sums, [corpus, cluster]).groupBy("rep", corpus, stratum, "reference").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("m"))
    out = per.groupBy("rep", corpus).agg(F.sum(F.col("reference") * F.col("m")).alias("mean"), F.count(F.lit(1)).alias("got")).join(F.broadcast(strata), corpus)
    return out.select("rep", corpus, F.when(F.col("got") == F.col("strata"), F.col("mean")).alias("mean"))


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """Restricted cubic spline: x, then one term for all but the last two knots; linear beyond the ends."""
    first, last, before = knots[0], knots[-1], knots[-2]
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), 3)
    scale = (last - first) ** 2
    return [x, *((cube(k) - cube(before) * ((last - k) / (last - before)) + cube(last) * ((before - k) / (last - before))) / scale for k in knots[:-2])]


def spline_knots(df: DataFrame, value: str, ps: tuple[float, ...] = (0.05, 0.275, 0.5, 0.725, 0.95)) -> list[float]:
    """Quantiles as knots; ValueError unless they are distinct."""
    row = quantiles(df.withColumn("__all", F.lit(1)), value, ["__all"], {f"k{i}": p for i, p in enumerate(ps)}).first()
    knots = [float(row[f"k{i}"]) for i in range(len(ps))]
    if any(a >= b for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError(f"knots are not distinct: {knots}")
    return knots


#: Rows of a design that are factored at once, and factors that meet in one step of the tree.
_ROWS, _FAN = 4096, 16


def _factor(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def triangle(design: DataFrame) -> np.ndarray:
    """The triangle R of a QR factorisation of all columns of a design: blocks of rows are factored in their tasks, and factors merged in a tree, ``_FAN`` at a time.

    R holds all that least squares need, and unlike X'X it does not square the design's condition. Rows with a null are left out.
    """
    width = len(design.columns)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, width))
            for i in range(0, len(x), _ROWS):
                own = [_factor([*own, x[i : i + _ROWS]])]
        if own:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([own[0].ravel().tolist()], pa.list_(pa.float64()))})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [_factor([np.array(x["r"]).reshape(-1, width) for x in held]).ravel().tolist() for held in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.list_(pa.float64()))], names=["slot", "r"])

    kind = "slot long, r array<double>"
    factors = written(design.na.drop().mapInArrow(leaves, kind), "factors")
    while (factors.agg(F.max("slot")).first()[0] or 0) > 0:
        held = factors.groupBy(F.floor(F.col("slot") / _FAN).cast("long").alias("slot")).agg(F.array_sort(F.collect_list(F.struct("slot", "r"))).alias("held"))  # _FAN at most
        factors = written(held.mapInArrow(merged, kind), "factors")
    last = factors.first()
    return np.array(last["r"]).reshape(-1, width) if last else np.zeros((0, width))


def cluster_ols(rows: DataFrame, y: str, terms: dict[str, Column], cluster: str) -> dict:
    """Least squares with CR1 cluster-robust covariance.

    Coefficients come from the triangle of a QR factorisation merged over the tasks, the clusters' scores are sums in Spark; only p by p matrices come to the driver.
    Returns names, coefficients, standard errors, n, clusters, r2, rmse, rank and condition (of the design with columns of length one); ValueError if it is not of full rank.
    """
    names, p = list(terms), len(terms)
    x = [F.col(f"x{i}") for i in range(p)]
    d = rows.select(F.col(y).cast("double").alias("y"), F.col(cluster).alias("g"), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values())))
    d = written(d.na.drop(subset=["y", *(f"x{i}" for i in range(p))]), "design")
    s = d.agg(F.sum(F.col("y") ** 2).alias("yy"), F.sum("y").alias("ys"), F.count(F.lit(1)).alias("n"), F.countDistinct("g").alias("groups")).first()
    r = triangle(d.select(*(f"x{i}" for i in range(p)), "y"))
    r = np.vstack([r, np.zeros((max(0, p + 1 - len(r)), p + 1))])
    length = np.linalg.norm(r[:, :p], axis=0)
    sizes = np.linalg.svd(r[:p, :p] / np.where(length > 0, length, 1), compute_uv=False)
    rank = int((sizes > 1e-12 * sizes[0]).sum()) if sizes[0] > 0 else 0
    if rank < p:
        raise ValueError(f"the design is not of full rank: {rank} of {p}")
    beta, back = np.linalg.solve(r[:p, :p], r[:p, p]), np.linalg.inv(r[:p, :p])
    inverse = back @ back.T
    fitted = sum((x[i] * float(beta[i]) for i in range(1, p)), x[0] * float(beta[0]))
    e = d.withColumn("e", F.col("y") - fitted)
    scores = e.groupBy("g").agg(*(F.sum(x[i] * F.col("e")).alias(f"s{i}") for i in range(p)), F.sum(F.col("e") ** 2).alias("ee"))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    m = scores.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs), F.sum("ee").alias("sse")).first()
    meat = np.zeros((p, p))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = m[f"m{i}_{j}"]
    n, g = s["n"], s["groups"]
    cov = inverse @ meat @ inverse * (g / (g - 1) * (n - 1) / (n - p))
    fit = {"names": names, "beta": beta, "cov": cov, "se": np.sqrt(np.diag(cov)), "n": n, "clusters": g, "sse": m["sse"], "r2": 1 - m["sse"] / (s["yy"] - s["ys"] ** 2 / n), "rmse": float(np.sqrt(m["sse"] / n))}
    return fit | {"rank": rank, "condition": float(sizes[0] / sizes[-1])}


#: Fixed value: the two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def contrast(fit: dict, weights: dict[str, float]) -> tuple[float, float, float, float]:
    """(estimate, standard error, low, high) of a linear combination of coefficients."""
    c = np.array([weights.get(n, 0.0) for n in fit["names"]])
    value, error = float(c @ fit["beta"]), float(np.sqrt(c @ fit["cov"] @ c))
    return value, error, value - Z95 * error, value + Z95 * error


def heterogeneous(gaps: list[float], least_range: float = 0.1) -> bool:
    """Whether length-specific gaps range by ``least_range`` or change sign."""
    return max(gaps) - min(gaps) >= least_range or min(gaps) < 0 < max(gaps)


def kendall_tau(df: DataFrame, x: str, y: str, key: str, by: list[str], strips: int = 64) -> DataFrame:
    """Kendall's tau-b of groups of any size: pairs are counted, never made; null where a side is constant.

    Values go to ``strips`` ranges of x and of y. Pairs whose ranges differ in both follow from the counts of the cells of
    that grid; those that share a range are counted within it, in time that grows with m log m. Rows with a null in
    either value are left out.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranks = rows
    for v, strip in (("__x", "__i"), ("__y", "__j")):
        at = cumulative(rows, v, by).select(*by, v, F.least(F.lit(strips - 1), F.floor(F.col("cum_before") * strips / F.col("cum_total"))).cast("int").alias(strip))
        ranks = ranks.join(at, [*by, v])
    points = written(ranks.groupBy(*by, "__x", "__y", "__i", "__j").agg(F.count(F.lit(1)).alias("__n")), "points")
    pairs = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    tied = lambda *c: points.groupBy(*by, *c).agg(F.sum("__n").alias("__n")).groupBy(*by).agg(pairs("__n").alias("tied_" + "".join(x[-1] for x in c)))
    cells = points.groupBy(*by, "__i", "__j").agg(F.sum("__n").alias("__n"))
    full = points.groupBy(*by).agg(F.sum("__n").alias("__n"))
    grid = cells.select(*by, "__i").distinct().join(cells.select(*by, "__j").distinct(), by).join(cells, [*by, "__i", "__j"], "left") if by else cells.select("__i").distinct().crossJoin(cells.select("__j").distinct()).join(cells, ["__i", "__j"], "left")
    # Of the at most strips^2 cells: those with lesser ranges in both.
    along = Window.partitionBy(*by, "__i").orderBy("__j").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by, "__j").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    below = grid.withColumn("__row", F.sum("__n").over(along)).withColumn("__below", F.sum("__row").over(across))
    apart = below.groupBy(*by).agg(F.sum(F.col("__n").cast("double") * F.col("__below")).alias("apart"))
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def count(first: str):
        def run(d: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{b: [d[b].iat[0]] for b in by}, "c": [dominated(d[first].to_numpy(), d["__y"].to_numpy(), d["__n"].to_numpy())]})

        return run

    schema = f"{kinds}{', ' if by else ''}c double"
    same_x = points.groupBy(*by, "__i").applyInPandas(count("__x"), schema)
    same_y = points.groupBy(*by, "__j").applyInPandas(count("__i"), schema)
    inside = same_x.union(same_y).groupBy(*by).agg(F.sum("c").alias("inside"))
    out = full
    for part in (tied("__x"), tied("__y"), tied("__x", "__y"), apart, inside):
        out = out.join(part, by) if by else out.crossJoin(part)
    all_ = F.col("__n").cast("double") * (F.col("__n") - 1) / 2
    up = F.coalesce("apart", F.lit(0.0)) + F.col("inside")
    surplus = 2 * up - (all_ - F.col("tied_x") - F.col("tied_y") + F.col("tied_xy"))
    return out.select(*by, F.try_divide(surplus, F.sqrt(all_ - F.col("tied_x")) * F.sqrt(all_ - F.col("tied_y"))).alias("tau"))


def dominated(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """How many pairs of points (with multiplicities n) are less in x and in y; strips of halves of the ranks, one bit of them after another."""
    a, b = np.unique(x, return_inverse=True)[1].astype(np.int64), np.unique(y, return_inverse=True)[1].astype(np.int64)
    total, width = 0.0, int(b.max()) + 1
    for bit in range(int(a.max()).bit_length()):
        place = (a >> (bit + 1)) * width + b
        left = (a >> bit & 1) == 0
        order = np.argsort(place[left], kind="stable")
        held, sums = place[left][order], np.concatenate([[0], np.cumsum(n[left][order])])
        first = (place[~left] // width) * width
        total += float((n[~left] * (sums[np.searchsorted(held, place[~left])] - sums[np.searchsorted(held, first)]).astype(np.float64)).sum())
    return total
