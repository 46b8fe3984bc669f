"""Mixing sources to target weights: whole copies that are certain, then a Pareto order sample of a fixed number of words.

A source that shall give r times its words gives floor(r) copies of each document. The rest, a fraction f of
its words, is a sample without replacement in which a document is included with odds f / (1 - f) times its
merit: documents are ranked by their random odds u / (1 - u) divided by their inclusion odds, and the
first stay until the words are there. u comes from a digest of the row, so a rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KEY, TEXT, written

WEIGHTS, MOST = (5, 2, 1), 3
#: Ranks are whole numbers of so many bits; a step looks at so many more of them.
BITS, STEP = 52, 10
#: The rows of a source that one task may sort, and the sources a broadcast may hold.
FEW, SOURCES = 4096, 10_000


def _rows(docs: DataFrame, key: str, text: str, source: str, merit: Column | None) -> DataFrame:
    """``KEY, source, name, size, u, merit``: name tells null from a source of any name."""
    value, words, origin = F.col(f"`{key}`"), F.col(f"`{text}`"), F.col(f"`{source}`").cast("string")
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit(":"), F.coalesce(words, F.lit(""))).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    return docs.select(
        value.alias(KEY), origin.alias("source"), F.coalesce(F.concat(F.lit("="), origin), F.lit("-")).alias("name"),
        F.coalesce(F.regexp_count(words, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ((bits + F.lit(0.5)) / F.lit(float(1 << BITS))).alias("u"), (F.lit(1.0) if merit is None else F.coalesce(merit.cast("double"), F.lit(0.0))).alias("merit"),
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources(source, name, source_size)`` with ``target``: shares of all words by weight, none above ``most`` times the source's own.

    Weights go round over the sources by code point, null last. Where the level of sharing meets a source's limit first, the source has
    its limit: sorted by limit over weight, those are the first ones. One row a source is in one task here, and no more.
    """
    names = Window.orderBy(F.col("source").isNull(), "source")
    given = F.array(*(F.lit(w) for w in weights))[(F.row_number().over(names) - 1) % len(weights)]
    held = sources.withColumn("weight", given).withColumn("limit", F.col("source_size") * most)
    order, everything = Window.orderBy(F.col("limit") / F.col("weight"), "name"), Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(everything)
    full = held.withColumn("full", F.col("limit") * left <= (whole - before) * F.col("weight"))
    spent, open_ = (F.coalesce(F.sum(F.when(c, v)).over(everything), F.lit(0)) for c, v in ((F.col("full"), F.col("limit")), (~F.col("full"), F.col("weight"))))
    share = ((whole - spent) * F.col("weight")).cast("double") / F.nullif(open_, F.lit(0))
    return full.select("source", "name", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def _by_source(rows: DataFrame, plan: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with what the plan says of their source; the plan is broadcast if its rows were counted and are few."""
    return rows.join(F.broadcast(plan) if few else plan, "name", how)


def first_words(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """``name, cut, filled``: the rank before which the words of ``rows(name, place, size)`` don't exceed the source's ``left``, and their number.

    The sums of 1,024 ranges of ranks say which range holds the cut; its rows are looked at by 1,024 narrower ranges, until
    no source has more than FEW rows in the range of its cut. Rows of one rank stay together. A cut of null takes all.
    """
    shift, base = BITS - STEP, budgets.select("name", "left", F.lit(0).cast("long").alias("base"))
    total = rows.groupBy("name").agg(F.sum("size").alias("total"))
    while True:
        ranges = rows.groupBy("name", F.shiftright("place", shift).alias("range")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        sums = F.sum("words").over(Window.partitionBy("name").orderBy("range"))
        over = _by_source(ranges.withColumn("upto", sums), base, few).withColumn("upto", F.col("upto") + F.col("base")).where("upto > left")
        cut = over.groupBy("name", "left").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("base"), "n")).alias("c"))
        base = written(cut.select("name", "left", "c.range", "c.base", "c.n"), "cuts")
        most = base.agg(F.max("n")).first()[0] or 0
        inside = _by_source(rows, base.select("name", "range", "base", "left"), few).where(F.shiftright("place", shift) == F.col("range"))
        if most <= FEW or shift == 0:
            break
        rows, base = written(inside.select("name", "place", "size"), "inside"), base.select("name", "left", "base")
        shift = max(0, shift - STEP)
    ranks = inside.groupBy("name", "place", "base", "left").agg(F.sum("size").alias("size"))
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("name").orderBy("place"))
    at = ranks.withColumn("upto", upto).where("upto > left").groupBy("name").agg(F.min(F.struct("place", (F.col("upto") - F.col("size")).alias("filled"))).alias("c"))
    return _by_source(total, at, few, "left").select("name", F.col("c.place").alias("cut"), F.coalesce("c.filled", "total").alias("filled"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, merit: Column | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of docs: ``key, source, size, source_size, target, copies, taken`` (words: copies times size).

    ``merit`` multiplies a document's inclusion odds; null or below zero counts as zero, which only certain copies can take. The sample
    of a source is filled in rank order up to its words, once more with the documents that still fit, and closed with the
    one document that brings it nearest. So no document left out would alone bring a source nearer to its target.
    A null text has no words, and a source without words a target of zero; a null source is a source. Rows that agree in key, text and source
    are taken together or not at all. Other columns, whatever their names, are not read.
    """
    rows = written(_rows(docs, key, text, source, merit), "mix")
    plan = written(targets(rows.groupBy("source", "name").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    few = plan.count() <= SOURCES
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", rate).withColumn("left", F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") + F.lit(0.5)).cast("long") - F.col("whole") * F.col("source_size")))
    plan = plan.withColumn("f", F.when(F.col("left") > 0, F.col("left") / F.col("source_size")))
    fills_type = "array<struct<most:bigint,cut:bigint>>"
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")) * F.col("merit"))
    place = F.when((F.col("f") > 0) & (F.col("f") < 1) & (F.col("merit") > 0), F.floor(F.least(odds, F.lit(1e300)) / (1 + F.least(odds, F.lit(1e300))) * F.lit(float(1 << BITS))).cast("long"))
    ranked = _by_source(rows, plan.select("name", "f"), few).withColumn("place", place).select("name", "place", "size").where("place IS NOT NULL AND size > 0")
    # limit and cut of each filling; a row is taken if its size is within the limit and its rank before the cut.
    state = plan.select("name", "left", F.array().cast(fills_type).alias("fills"))
    taken = F.exists("fills", lambda c: (F.col("size") <= c["most"]) & (F.col("place") < F.coalesce(c["cut"], F.lit(1 << 62))))
    for _ in range(2):
        fit = _by_source(ranked, state, few).where(~taken & (F.col("size") <= F.col("left"))).select("name", "place", "size")
        got = first_words(fit, state.select("name", "left"), few)
        fill = F.array(F.struct(F.col("left").alias("most"), F.col("cut")))
        fills = F.when(F.col("filled").isNull(), F.col("fills")).otherwise(F.concat("fills", fill))
        state = written(_by_source(state, got, few, "left").select("name", (F.col("left") - F.coalesce("filled", F.lit(0))).alias("left"), fills.alias("fills")), "fills")
    near = _by_source(ranked, state, few).where(~taken & (F.col("size") < 2 * F.col("left"))).groupBy("name", "place", "left").agg(F.sum("size").alias("size")).where("size < 2 * left")
    last = near.groupBy("name").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")), "place")).alias("c")).select("name", F.col("c.place").alias("last"))
    ends = written(_by_source(state, last, few, "left"), "ends")
    every = _by_source(rows, plan.select("name", "source_size", "target", "whole", "f").join(ends, "name"), few).withColumn("place", place)
    # The closing rank's rows that an earlier filling could have taken are none: they would be taken.
    drawn = F.when((F.col("size") > 0) & F.col("place").isNotNull(), taken | (F.coalesce(F.col("place") == F.col("last"), F.lit(False)) & (F.col("size") < 2 * F.col("left")))).otherwise(F.lit(False))
    copies = F.col("whole") + drawn.cast("long")
    return every.select(F.col(KEY).alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
