"""Choosing rows: best of several candidates, samples, splits, sides and blind order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .order import average_ranks, positions, row_number, top


def policy_key(delta: Column, kind: Column) -> Column:
    """Smaller is better: the largest delta for additions, the smallest for removals, the least change for rewrites."""
    return F.when(kind == "add_specific", -delta).when(kind == "de_specify", delta).otherwise(F.abs(delta))


def best_of_n(candidates: DataFrame, delta: str = "delta", kind: str = "edit_type", case: str = "case_id", slot: str = "slot", by: tuple[str, ...] = ()) -> DataFrame:
    """The chosen candidate of each case (and metric): lowest key, then lowest slot; a minimum, so no sort of the case."""
    key = F.struct(policy_key(F.col(delta), F.col(kind)).alias("k"), F.col(slot).alias("s"))
    return candidates.where(F.col(delta).isNotNull()).groupBy(case, *by).agg(F.min(key).alias("best")).select(case, *by, F.col("best.s").alias(slot))


def consensus(candidates: DataFrame, delta: str, kind: str, metric: str, case: str = "case_id", slot: str = "slot") -> DataFrame:
    """The slot with the least sum of ranks over the metrics, then the lowest."""
    order = Window.partitionBy(case, metric).orderBy(policy_key(F.col(delta), F.col(kind)), slot)
    sums = candidates.withColumn("r", F.row_number().over(order)).groupBy(case, slot).agg(F.sum("r").alias("rank_sum"))
    return sums.groupBy(case).agg(F.min(F.struct("rank_sum", slot)).alias("best")).select(case, f"best.{slot}", "best.rank_sum")


def half_split(rows: DataFrame, key: str, by: list[str], seed: str, names: tuple[str, str] = ("development", "held_out"), out: str = "part") -> DataFrame:
    """Half of each stratum, by seeded hash order; the first name gets the smaller half of an odd one."""
    numbered = row_number(rows, [key], by, "__i", key=F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return numbered.withColumn(out, F.when(F.col("__i") < F.floor(F.col("total") / 2), names[0]).otherwise(names[1])).drop("__i", "total")


def packet_order(rows: DataFrame, key: str, seed: str, out: str = "position") -> DataFrame:
    """A seeded order of all rows, from 1."""
    return row_number(rows.withColumn("__all", F.lit(0)), [key], ["__all"], "__i", key=F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))).withColumn(out, F.col("__i") + 1).drop("__i", "__all", "total")


def keep_first(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row of each text, the first in the order; copies are pruned before they are moved."""
    best = F.min_by(F.struct("*"), F.struct(*order))
    return rows.groupBy(F.col(text).alias("__t")).agg(best.alias("r")).select("r.*")


def proxy_index(rows: DataFrame, columns: list[str], by: list[str], out: str = "proxy_index") -> DataFrame:
    """The mean average rank of several columns over the group's rows."""
    d = average_ranks(rows, {c: f"__{i}" for i, c in enumerate(columns)}, by, total="__n")
    mean = sum((F.col(f"__{i}") for i in range(1, len(columns))), F.col("__0")) / len(columns)
    return d.withColumn(out, mean / F.col("__n")).drop("__n", *(f"__{i}" for i in range(len(columns))))


def edges(rows: DataFrame, value: str, key: str, by: list[str], out: str, share: int = 4) -> DataFrame:
    """Rows with ``out`` low, mid or high: the first and last floor(n / share), at least one, by (value, key); their ``{out}_position`` and ``{out}_total``.

    Rows without a value are left out.
    """
    at, n = f"{out}_position", f"{out}_total"
    d = positions(rows.where(F.col(value).isNotNull()), [value, key], by, at, n)
    q = F.greatest(F.lit(1), F.floor(F.col(n) / share))
    return d.withColumn(out, F.when(F.col(at) <= q, "low").when(F.col(at) > F.col(n) - q, "high").otherwise("mid"))


def divergence(rows: DataFrame, score: str, proxy: str, key: str, by: list[str], k: int = 20) -> DataFrame:
    """``by..., bucket, key, position``: high score with low proxy, low score with high proxy, the lowest, and those nearest to the middle row.

    Mid-range rows are the k nearest in score to the middle row, out of the 4 k around it.
    """
    # Only rows at an edge of the scores, or around their middle, can be picked: what is left of the ranking is small, and written once.
    base = written(rows.select(*by, key, score, proxy), "divergence")  # ranges are drawn from a first reading, rows dealt in a second
    d = edges(edges(base, proxy, key, by, "proxy_edge"), score, key, by, "score_edge")
    off = F.col("score_edge_position") - 1 - F.floor(F.col("score_edge_total") / 2)
    picked = (F.col("score_edge_position") <= k) | (F.abs(off) <= 2 * k) | F.col("score_edge").isin("high", "low") & F.col("proxy_edge").isin("high", "low") & (F.col("score_edge") != F.col("proxy_edge"))
    d = written(d.withColumn("off", off).where(picked), "ranked")
    middle = d.where("off = 0").select(*by, F.col(score).alias("mid"))
    parts = [
        (d.where("score_edge = 'high' and proxy_edge = 'low'"), "high_score_low_proxy", [F.desc(score), F.col(key)]),
        (d.where("score_edge = 'low' and proxy_edge = 'high'"), "low_score_high_proxy", [F.asc(score), F.col(key)]),
        (d.where(F.col("score_edge_position") <= k), "lowest", [F.asc("score_edge_position")]),
        (d.where(F.abs("off") <= 2 * k).join(middle, by), "mid_range", [F.abs(F.col(score) - F.col("mid")), F.col(key)]),
    ]
    out = None
    for frame, name, order in parts:
        part = top(frame, k, order, by).select(*by, F.lit(name).alias("bucket"), key, "position")
        out = part if out is None else out.unionByName(part)
    return out


def spot_check(rows: DataFrame, score: str, key: str, text: str, by: list[str], edge: int = 10, average: int = 10) -> DataFrame:
    """``by..., bucket, key``: extremes and middle of the scores with unique texts; a bucket that lost a copy is filled up in order.

    Each bucket is drawn from so many candidates that the fill cannot run out: copies of one text are
    first reduced to the first by (score, key), which is what keeps a text unique in order.
    """
    unique = keep_first(rows.select(*by, score, key, text).withColumn("__u", F.concat_ws("\x00", *by, text)), "__u", [score, key]).drop("__u")
    d = edges(unique, score, key, by, "score_edge")
    low_n, high_n = edge // 2, edge - edge // 2
    at = F.col("score_edge_position")
    total = F.col("score_edge_total")
    ends = d.withColumn("bucket", F.when(at <= low_n, "low").when(at > total - high_n, "high"))
    mid = d.where(at - 1 == F.floor(total / 2)).select(*by, F.col(score).alias("mid"))
    rest = ends.where("bucket is null").join(F.broadcast(mid), by)  # a row for each group, of which there are few
    near = top(rest, average, [F.abs(F.col(score) - F.col("mid")), F.col(key)], by).select(*by, F.lit("average").alias("bucket"), key)
    return ends.where("bucket is not null").select(*by, "bucket", key).unionByName(near)


def edit_template(rows: DataFrame, score: str, key: str, by: list[str], each: int, seed: str, kinds: tuple[str, ...]) -> DataFrame:
    """``by..., pool, key, edit_type``: seeded picks from the bottom tenth, the top tenth and the rows nearest to the median, directions in turn."""
    total = F.col("score_edge_total")
    d = edges(rows, score, key, by, "score_edge", share=10).withColumn("__tenth", F.greatest(F.lit(1), F.floor(total / 10)))
    pool = F.when(F.col("score_edge") != "mid", F.col("score_edge")).when(F.abs(F.col("score_edge_position") - 1 - F.floor(total / 2)) * 2 <= F.col("__tenth"), "median")
    d = d.withColumn("pool", pool).where("pool is not null").withColumn("__h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256))
    picked = top(d, each, [F.col("__h"), F.col(key)], [*by, "pool"])
    names = F.array(*map(F.lit, kinds))
    return picked.select(*by, "pool", key, F.element_at(names, (F.pmod(F.col("position") - 1, F.lit(len(kinds))) + 1).cast("int")).alias("edit_type"))
