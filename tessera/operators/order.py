"""Ranks, exact quantiles and row numbers that no single task has to hold.

Equal values are counted first, so a frequent value is one row. Values then go to buckets of about
equal size, each is summed by itself, and only the buckets' totals, a bounded number, are accumulated
to know how many rows lie before each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written


#: Cuts are looked up in two steps of so many each.
_STEP = 32


def spread(df: DataFrame) -> int:
    """Into how many buckets a group is dealt: a thousand on a cluster whose shuffles have over 64 partitions."""
    return _STEP * _STEP if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 64 else _STEP


def _bucket(value: Column, buckets: int) -> Column:
    """How many of the ascending ``cum_cuts`` are no greater than the value."""
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c <= value))
    if buckets <= _STEP:
        return below(F.col("cum_cuts"))
    coarse = below(F.transform(F.sequence(F.lit(1), F.lit(buckets // _STEP - 1)), lambda i: F.element_at("cum_cuts", i * _STEP)))
    return coarse * _STEP + below(F.slice(F.col("cum_cuts"), coarse * _STEP + 1, F.lit(_STEP - 1)))


#: Different values that one task of a cluster sorts; a bucket of more is dealt to buckets of its own.
MOST = 200_000


def cumulative(df: DataFrame, value: str, by: list[str], buckets: int | None = None, most: int = MOST, times: str | None = None) -> DataFrame:
    """``by..., value, cum_n, cum_before, cum_total``: each distinct non-null value, its count, and how many rows are less.

    ``by`` has few groups of any size. For many small groups use a window (``ranks_within``). ``buckets``: by default as
    many as ``spread`` says. With more than 32, a bucket of over ``most`` different values is dealt again, and so on, so the largest task follows ``most`` and
    not the table. ``times``: a column that says for how many rows a row stands.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("cum_n"))
    return _cumulated(counts, value, by, spread(df) if buckets is None else buckets, most, 0)


def _cumulated(counts: DataFrame, value: str, by: list[str], buckets: int, most: int, depth: int) -> DataFrame:
    place = f"cum_bucket{depth}"
    if buckets > 1:
        # Of the distinct values: these are what the buckets hold, and the counts' shuffle is read again.
        cuts = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(max(1000, 10 * buckets))).alias("cum_cuts"))
        few = cuts if depth else F.broadcast(cuts)  # the caller's groups are few; buckets that are dealt again need not be
        counts = counts.join(few, by) if by else counts.crossJoin(few)
        counts = counts.withColumn(place, _bucket(F.col(value), buckets)).drop("cum_cuts")
    else:
        counts = counts.withColumn(place, F.lit(0))
    own = [*by, place]
    inside = (F.sum("cum_n").over(Window.partitionBy(*own).orderBy(value)) - F.col("cum_n")).alias("cum_inside")
    large = None
    if buckets > _STEP:
        counts = written(counts, "values")
        large = written(counts.groupBy(*own).count().where(F.col("count") > most).select(*own), "large")
    if large is None or large.isEmpty():
        placed = counts.select("*", inside)
    else:
        deep = _cumulated(counts.join(large, own, "left_semi"), value, own, buckets, most, depth + 1)
        placed = counts.join(large, own, "left_anti").select("*", inside).unionByName(deep.withColumnRenamed("cum_before", "cum_inside").drop("cum_total"))
    sums = counts.groupBy(*own).agg(F.sum("cum_n").alias("cum_size"))
    ordered = Window.partitionBy(*by).orderBy(place)  # at most ``buckets`` rows a group
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(*own, (F.sum("cum_size").over(ordered) - F.col("cum_size")).alias("cum_offset"), F.sum("cum_size").over(whole).alias("cum_total"))
    return placed.join(sums if depth else F.broadcast(sums), own).select(*by, value, "cum_n", (F.col("cum_offset") + F.col("cum_inside")).alias("cum_before"), "cum_total")


def ranges(df: DataFrame, value: str, by: list[str], buckets: int, out: str = "range") -> DataFrame:
    """Rows with the number of one of ``buckets`` ranges of about as many different values each, in order of the values within ``by``."""
    if buckets == 1:
        return df.withColumn(out, F.lit(0))
    cuts = df.select(*by, value).distinct().groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(max(1000, 10 * buckets))).alias("cum_cuts"))
    dealt = df.join(F.broadcast(cuts), by) if by else df.crossJoin(F.broadcast(cuts))  # a row for each of few groups: by their keys, a group would meet in one task
    return dealt.withColumn(out, _bucket(F.col(value), buckets)).drop("cum_cuts")


def positions(df: DataFrame, order: list[str], by: list[str], out: str = "position", total: str = "total") -> DataFrame:
    """Rows with their position, from 1, in the order of the columns within ``by``, and the group's size; by has few groups.

    Rows are dealt by ranges of group and order, so neither a large group nor a frequent value has to lie in one task.
    Each range is numbered where it lies and written once; of the ranges only their counts are accumulated.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__m", F.monotonically_increasing_id())
    ranged = written(ranged, "positions").withColumn("__part", F.shiftright("__m", 33))
    counts = ranged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    ordered = Window.partitionBy(*by).orderBy("__part")  # a row for each range
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select(*(F.col(b).alias(f"__by{i}") for i, b in enumerate(by)), F.col("__part").alias("__range"), (F.sum("__n").over(ordered) - F.col("__n") - F.col("__first") + 1).alias("__shift"), F.sum("__n").over(whole).alias(total))
    same = F.col("__part") == F.col("__range")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    return ranged.join(F.broadcast(counts), same).withColumn(out, F.col("__m") + F.col("__shift")).drop("__m", "__part", "__range", "__shift", *(f"__by{i}" for i in range(len(by))))


def average_ranks(df: DataFrame, columns: dict[str, str], by: list[str], buckets: int | None = None, total: str | None = None) -> DataFrame:
    """Rows with the mean of their tied positions, from 1, within ``by``, for each column: ``columns`` maps values to results.

    Rows with a null in one of the columns are left out before any is ranked. All ranks come from ``df`` itself, so the plan grows with the columns and no faster.
    """
    base = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    out = base
    for i, (value, name) in enumerate(columns.items()):
        ranks = cumulative(base.select(*by, value), value, by, buckets).select(*by, value, (F.col("cum_before") + (F.col("cum_n") + 1) / 2).alias(name), *([F.col("cum_total").alias(total)] if total and not i else []))
        out = out.join(ranks, [*by, value])
    return out


def average_rank(df: DataFrame, value: str, by: list[str], out: str = "rank", buckets: int | None = None, total: str | None = None) -> DataFrame:
    """The same for one column."""
    return average_ranks(df, {value: out}, by, buckets, total)


def mid_ranks(df: DataFrame, columns: dict[str, str], by: list[str], buckets: int | None = None) -> DataFrame:
    """(average rank - 1/2) / rows, for each column."""
    ranked = average_ranks(df, columns, by, buckets, "__n")
    return ranked.withColumns({out: (F.col(out) - 0.5) / F.col("__n") for out in columns.values()}).drop("__n")


def mid_rank(df: DataFrame, value: str, by: list[str], out: str = "mid_rank", buckets: int | None = None) -> DataFrame:
    return mid_ranks(df, {value: out}, by, buckets)


def ranks_within(value: Column, *by: str) -> Column:
    """Average rank as a window expression, for groups that are small by nature (cases, replicates)."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def quantiles(df: DataFrame, value: str, by: list[str], ps: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row a group, one column for each name in ``ps``."""
    steps = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in ps.items()))
    at = cumulative(df, value, by, buckets).withColumn("s", F.explode(steps)).withColumn("pos", F.col("s.p") * (F.col("cum_total") - 1))
    low, high = F.floor("pos"), F.ceil("pos")
    holds = lambda x: (F.col("cum_before") <= x) & (x < F.col("cum_before") + F.col("cum_n"))
    hits = at.where(holds(low) | holds(high))
    found = lambda k, x: F.max(F.when((F.col("s.name") == k) & holds(x), F.col(value)))
    part = lambda k: F.max(F.when(F.col("s.name") == k, F.col("pos") - low))
    return hits.groupBy(*by).agg(*((found(k, low) + (found(k, high) - found(k, low)) * part(k)).alias(k) for k in ps))


def row_number(df: DataFrame, order: list, by: list[str], out: str = "row", key: Column | None = None) -> DataFrame:
    """Rows numbered from 0 within ``by`` in the order of the hash of ``key``, then ``order``; and their ``total``.

    A seeded shuffle: the digest's first hexadecimal digits are the buckets, 256 of them or, on a large cluster, 4,096.
    """
    digest = F.sha2(key, 256)
    rows = df.withColumn("__h", digest).withColumn("__b", F.conv(F.substring("__h", 1, 2 if spread(df) == _STEP else 3), 16, 10).cast("int"))
    rows = rows.withColumn("__inner", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", *order)) - 1)
    sums = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    ordered = Window.partitionBy(*by).orderBy("__b")  # a row for each bucket
    sums = sums.select(*by, "__b", (F.sum("__n").over(ordered) - F.col("__n")).alias("__o"), F.sum("__n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return rows.join(F.broadcast(sums), [*by, "__b"]).withColumn(out, F.col("__o") + F.col("__inner")).drop("__h", "__b", "__inner", "__o")


def top(df: DataFrame, k: int, order: list, by: list[str], out: str = "position") -> DataFrame:
    """The first k rows of each group in a total order; Spark prunes to k rows a group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)
