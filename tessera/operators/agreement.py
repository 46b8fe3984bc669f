"""Agreement between annotators, judges and scorers, and outcomes of reviewed edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percentile, ratio


def kappa(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """``by..., n, agreement, kappa, kappa_linear, kappa_quadratic``; weights are by the rank of a label among those used.

    Null where expected disagreement is 0. Labels are few; everything but the counts is a tiny table.
    """
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    table = cells.groupBy(*by).agg(F.collect_list(F.struct("a", "b", "n")).alias("cells"), F.sum("n").alias("n"))
    table = table.withColumn("labels", F.array_sort(F.array_distinct(F.concat(F.transform("cells", lambda c: c["a"]), F.transform("cells", lambda c: c["b"])))))
    index = lambda v: F.array_position(F.col("labels"), v)
    rows = lambda side, v: F.aggregate(F.filter("cells", lambda c: c[side] == v), F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    span = F.greatest(F.size("labels") - 1, F.lit(1))
    zero = F.lit(0.0)

    def value(weight) -> Column:
        seen = F.aggregate("cells", zero, lambda s, c: s + weight(index(c["a"]), index(c["b"])) * c["n"] / F.col("n"))
        chance = F.aggregate("labels", zero, lambda s, x: s + F.aggregate("labels", zero, lambda t, y: t + weight(index(x), index(y)) * rows("a", x) * rows("b", y) / (F.col("n") * F.col("n"))))
        return F.when(chance > 0, 1 - F.try_divide(seen, chance))

    gap = lambda i, j: F.abs(i - j) / span
    same = F.aggregate(F.filter("cells", lambda c: c["a"] == c["b"]), F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    return table.select(*by, "n", (same * 100.0 / F.col("n")).alias("agreement"), value(lambda i, j: (i != j).cast("double")).alias("kappa"), value(gap).alias("kappa_linear"), value(lambda i, j: gap(i, j) * gap(i, j)).alias("kappa_quadratic"))


def binned_gap(rows: DataFrame, score: str, label: str, levels: int, by: list[str]) -> DataFrame:
    """``by..., rows, bins, gap``: over equal-frequency bins of the score, the row-weighted distance of mean score and mean label in [0, 1].

    Edges are quantiles with duplicates dropped; bins are closed on the right; one bin if the edges coincide.
    """
    held = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("__l", (F.col(label) - 1) / (levels - 1))
    edges = held.groupBy(*by).agg(F.array_distinct(percentile(F.col(score), [0.2, 0.4, 0.6, 0.8, 1.0])).alias("edges"), F.min(score).alias("least"))
    edges = edges.select(*by, F.filter("edges", lambda e: e > F.col("least")).alias("edges"))
    binned = held.join(F.broadcast(edges), by).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(score))))
    means = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"), F.avg("__l").alias("l"))
    return means.groupBy(*by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("bins"), (F.sum(F.col("n") * F.abs(F.col("s") - F.col("l"))) / F.sum("n")).alias("gap"))


def confusion(rows: DataFrame, passed: Column, valid: Column, by: list[str]) -> DataFrame:
    """Counts of a proxy's pass against validity, and its false accept and false reject rates; null rates without a base."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    c = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count(valid.isNull()).alias("abstained"), count(passed & valid).alias("tp"), count(passed & ~valid).alias("fp"), count(~passed & valid).alias("fn"), count(~passed & ~valid).alias("tn"))
    return c.withColumns({"far": ratio(F.col("fp"), F.col("fp") + F.col("tn")), "frr": ratio(F.col("fn"), F.col("tp") + F.col("fn"))})


def review_delta(score: Column, side: Column) -> Column:
    """A rating of 1 to 5 of the pair (A, B) as -2 to 2 in favour of the candidate on ``side``; X is null."""
    value = 3 - F.try_to_number(score, F.lit("9")).cast("int")
    return F.when(score == "X", None).otherwise(F.when(side == "A", value).otherwise(-value))


def utility(delta: Column, kind: Column) -> Column:
    return F.when(kind == "add_specific", delta).when(kind == "de_specify", -delta).otherwise(-F.abs(delta))


def direction_valid(delta: Column, kind: Column) -> Column:
    """Whether a delta goes the way the edit should; an abstention is not valid."""
    ok = F.when(kind == "add_specific", delta > 0).when(kind == "de_specify", delta < 0).otherwise(delta == 0)
    return F.coalesce(ok, F.lit(False))


def consistent_direction(delta: Column, kind: Column, coarse_is_high: bool = False) -> Column:
    """The expected sign, flipped for a scorer that is high for coarse text; null for neutral edits and missing deltas."""
    d = -delta if coarse_is_high else delta
    return F.when(kind == "add_specific", d > 0).when(kind == "de_specify", d < 0)
