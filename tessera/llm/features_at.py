"""Point-in-time features: what was known of a client at each of its sales, by a coarse-bin interval join.

An event is seen by the window of d days at time t if it lies in it and has arrived: from v, the later of its
time and its arrival plus a delay, up to its time plus d days. So it is an interval of t, and it adds to the totals of its client at
the one end and takes away at the other. The changes are dealt to bins of time, a client each. Bins before
a probe's bin are wholly covered: the running total of their sums (a difference array) is what they say. In the
probe's own bin the changes themselves are joined and compared with t. Bins with more than FEW changes are
divided again, and again, by as many bits as the largest asks for; a bin of one microsecond is its own total.

The number of different items is made additive first: of the intervals of one client and item, each keeps only what the
ones before it don't cover. That needs a running maximum, which frequent pairs get from the same bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import write, written

SECOND = 1_000_000
DAY = 86_400 * SECOND
WINDOWS, DELAY, AHEAD = (2, 14), 240 * 60 * SECOND, 7 * DAY
#: Bins of 2^COARSE microseconds (3.2 days) come first; one with more than FEW changes is divided into 2^FAN at most.
COARSE, FEW, FAN = 38, 64, 10
#: Keys that may be listed in a broadcast.
LISTED = 1_000
#: Events of one client and item beyond which their running maximum is not left to one window.
PAIR = 10_000

#: What a change is about.
CLICK, PURCHASE, SALE, LINE, LABEL = range(5)
COUNTS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items")
#: Last clicks are ordered by one number, time * APART + id: time moved by SHIFT so that it is positive, a missing id below all others.
APART, SHIFT, NO_ID = 2 * 10**19, 10**18, -(10**19) + 1


@dataclass(frozen=True)
class Measure:
    name: str
    of: Column
    how: str = "sum"

    def total(self, column: Column) -> Column:
        return F.sum(column) if self.how == "sum" else F.max(column)


def micros(df: DataFrame, column: str) -> Column:
    """Epoch microseconds of a time in UTC, whatever the session's zone."""
    c = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    return F.unix_date(c.cast("date")) * F.lit(DAY) + (F.hour(c) * 60 + F.minute(c)).cast("long") * F.lit(60 * SECOND) + (F.date_part(F.lit("SECOND"), c) * SECOND).cast("long")


def cents(column: Column) -> Column:
    """Hundredths, halves up; nothing for null and what is not finite."""
    x = column.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) >= 9e16), F.lit(0)).otherwise(F.floor(x * 100 + 0.5)).cast("long")


def totals_until(changes: DataFrame, probes: DataFrame, keys: list[str], measures: list[Measure], coarse: int = COARSE, few: int = FEW) -> DataFrame:
    """For each row of ``probes(keys, at, …)`` the totals of the ``changes(keys, p, …)`` of its keys with p <= at.

    Each round handles the bins of one width: the totals of a bin's earlier siblings go to its probes; bins of at most ``few`` changes
    are joined with their probes; what lies in the others goes to the next round. No window holds more than
    the bins of one parent (for the first, the bins of the calendar), and no join more than ``few`` rows a probe.
    Each join is made once and written, so no plan, which the driver holds, has the joins of several rounds.
    """
    named = probes.columns
    parts, shift, parent = [], coarse, None
    while True:
        place, look = F.shiftright("p", shift).alias("bin"), F.shiftright("at", shift).alias("bin")
        rows = changes.select(*keys, place, *(m.of.alias(m.name) for m in measures), F.lit(1).alias("n"), F.lit(0).alias("asked"))
        asks = probes.select(*keys, look, *(F.lit(0 if m.how == "sum" else None).cast(rows.schema[m.name].dataType).alias(m.name) for m in measures), F.lit(0).alias("n"), F.lit(1).alias("asked"))
        bins = rows.unionByName(asks).groupBy(*keys, "bin").agg(*(m.total(F.col(m.name)).alias(m.name) for m in measures), F.sum("n").alias("n"), F.max("asked").alias("asked"))
        siblings = Window.partitionBy(*keys, *([] if parent is None else [F.shiftright("bin", parent - shift)])).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0 if shift == 0 else -1)
        before = [F.coalesce(m.total(F.col(m.name)).over(siblings), F.lit(0)).alias(m.name) if m.how == "sum" else m.total(F.col(m.name)).over(siblings).alias(m.name) for m in measures]
        table = written(bins.select(*keys, "bin", *before, "n", "asked").where("asked = 1"), "bins")
        there = written(probes.withColumn("bin", look).join(table.drop("asked").hint("merge"), [*keys, "bin"]), "there")
        parts.append(there.select(*named, *(m.name for m in measures)))
        if shift == 0:
            break
        held = there.where(f"n BETWEEN 1 AND {few}").select(*named, "bin")
        met = held.join(changes.withColumn("bin", place).hint("merge"), [*keys, "bin"]).where("p <= at")
        parts.append(written(met.select(*named, *(m.of.alias(m.name) for m in measures)).groupBy(*named).agg(*(m.total(F.col(m.name)).alias(m.name) for m in measures)), "met"))
        most = table.agg(F.max("n")).first()[0] or 0
        if most <= few:
            break
        hot = _beside(table.where(F.col("n") > few).select(*keys, "bin"))
        changes = written(changes.withColumn("bin", place).join(hot, [*keys, "bin"], "left_semi").drop("bin"), "changes")
        probes = there.where(F.col("n") > few).select(*named)
        parent, shift = shift, max(0, shift - min(FAN, math.ceil(math.log2(2 * most / few))))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*named).agg(*(m.total(F.col(m.name)).alias(m.name) for m in measures))


def _beside(small: DataFrame) -> DataFrame:
    """The side of a join that lists hot keys: broadcast if it was counted and has a thousand rows at most, else both sides are shuffled."""
    return F.broadcast(small) if small.limit(LISTED + 1).count() <= LISTED else small.hint("merge")


def _change(p: Column, kind: int, on: list[Column | int], n: Column | int = 0, value: Column | int = 0, item: list[Column | int] | None = None, last: Column | None = None) -> Column:
    """A change at p: ``on`` and ``item`` say, a window each, what n and value, and the number of items, are multiplied by."""
    as_ = lambda v, t, name: (v if isinstance(v, Column) else F.lit(v)).cast(t).alias(name)
    items = item or [0] * len(on)
    return F.struct(
        p.alias("p"), F.lit(kind).cast("byte").alias("kind"), *(as_(v, "byte", f"on{i}") for i, v in enumerate(on)), as_(n, "int", "n"), as_(value, "long", "value"),
        *(as_(v, "byte", f"item{i}") for i, v in enumerate(items)), (F.lit(None) if last is None else last).cast("decimal(38,0)").alias("last"),
    )


def _changes(df: DataFrame, *changes: tuple[Column | None, Column]) -> DataFrame:
    """One row a change whose condition holds."""
    rows = [c if given is None else F.when(given, c) for given, c in changes]
    return df.select("client_id", F.explode(F.array(*rows)).alias("c")).where("c IS NOT NULL").select("client_id", "c.*")


def _one(windows: tuple[int, ...], i: int, value: Column | int) -> list[Column | int]:
    return [value if j == i else 0 for j in range(len(windows))]


def _event(at: Column, seen: Column, kind: int | None, windows: tuple[int, ...], n: Column | int, value: Column, last: Column | None = None) -> list[tuple[Column, Column]]:
    """An event's changes: it comes into all windows when it is seen, if that is before it leaves them."""
    inside = [seen < at + d * DAY for d in windows]
    starts = (seen < at + max(windows) * DAY, _change(seen, kind, [F.when(c, 1).otherwise(0) for c in inside], n, value, last=last))
    return [starts, *((c, _change(at + d * DAY, kind, _one(windows, i, -1), n, value)) for i, (d, c) in enumerate(zip(windows, inside, strict=True)))]


def _clicks(clicks: DataFrame, windows: tuple[int, ...], delay: int) -> DataFrame:
    once = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").distinct()
    rows = once.select("client_id", "click_id", (F.coalesce("kind", F.lit("")) == "purchase").alias("bought"), cents(F.col("value")).alias("value"), micros(clicks, "ts").alias("ts"), micros(clicks, "arrived_at").alias("came"))
    rows = rows.withColumn("seen", F.greatest(F.col("ts"), F.col("came") + delay))
    last = (F.col("ts") + SHIFT).cast("decimal(20,0)") * F.lit(str(APART)).cast("decimal(20,0)") + F.coalesce(F.col("click_id").cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)"))
    both = [_event(F.col("ts"), F.col("seen"), kind, windows, 1, F.col("value"), last) for kind in (CLICK, PURCHASE)]
    return _changes(rows, *((c & ~F.col("bought"), x) for c, x in both[0]), *((c & F.col("bought"), x) for c, x in both[1]))


def _sales(sales: DataFrame, windows: tuple[int, ...], ahead: int) -> DataFrame:
    sold = F.col("sold")
    known = [(F.col("seen").isNotNull() & c, x) for c, x in _event(sold, F.col("seen"), SALE, windows, 1, F.col("value"))]
    first = _one(windows, 0, 1), _one(windows, 0, -1)
    return _changes(sales, *known, (None, _change(sold - ahead, LABEL, first[0], 1)), (None, _change(sold, LABEL, first[1], 1)))


def covered_before(rows: DataFrame, pair: int = PAIR) -> DataFrame:
    """``rows(client_id, item_id, seen, sold, …)`` with ``covered``: the latest ``sold`` of the pair's rows that are seen before, or seen then and sold later.

    A pair of up to ``pair`` rows is one window; the others' running maxima come from bins.
    """
    pairs = ["client_id", "item_id"]
    hot = written(rows.groupBy(*pairs).count().where(F.col("count") > pair).select(*pairs), "pairs")
    order = Window.partitionBy(*pairs).orderBy("seen", F.col("sold").desc()).rowsBetween(Window.unboundedPreceding, -1)
    if hot.isEmpty():
        return rows.withColumn("covered", F.max("sold").over(order))
    hot = _beside(hot)
    cold = rows.join(hot, pairs, "left_anti").withColumn("covered", F.max("sold").over(order))
    busy = written(rows.join(hot, pairs, "left_semi"), "busy")
    latest = busy.groupBy(*pairs, "seen").agg(F.max("sold").alias("latest"))
    until = totals_until(latest.select(*pairs, F.col("seen").alias("p"), "latest"), latest.select(*pairs, (F.col("seen") - 1).alias("at"), F.col("latest").alias("then")), pairs, [Measure("covered", F.col("latest"), "max")])
    found = busy.join(until.withColumn("seen", F.col("at") + 1).hint("merge"), [*pairs, "seen"])
    return cold.unionByName(found.select(*rows.columns, F.when(F.col("sold") < F.col("then"), F.col("then")).otherwise(F.col("covered")).alias("covered")))


def _lines(lines: DataFrame, sales: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Changes by lines: n and value from when both the sale and the shipping are known; the number of items where no earlier interval of the same item covers the time."""
    narrow = lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").select("sale_id", "item_id", cents(F.col("amount")).alias("value"), micros(lines, "shipped_at").alias("shipped"))
    known = sales.where("seen IS NOT NULL").select("sale_id", "client_id", "sold", F.col("seen").alias("sale_seen"))
    met = narrow.join(known.hint("merge"), "sale_id").select("client_id", "item_id", "sold", F.greatest("sale_seen", "shipped").alias("seen"), "value")
    rows = written(met.where(F.col("seen") < F.col("sold") + max(windows) * DAY).groupBy("client_id", "item_id", "seen", "sold").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("value").alias("value")), "lines")
    counted = covered_before(rows.where("item_id IS NOT NULL")).unionByName(rows.where("item_id IS NULL").withColumn("covered", F.lit(None).cast("long")))
    sold, seen, covered = F.col("sold"), F.col("seen"), F.col("covered")
    new = F.col("item_id").isNotNull() & (covered.isNull() | (sold > covered))
    ends = [sold + d * DAY for d in windows]
    inside = [seen < e for e in ends]
    opens = [F.greatest(seen, covered + d * DAY) for d in windows]
    counts = [new & (o < e) for o, e in zip(opens, ends, strict=True)]
    flag = lambda c: F.when(c, 1).otherwise(0)
    start = _change(seen, LINE, [flag(c) for c in inside], F.col("n"), F.col("value"), [flag(c & (o == seen)) for c, o in zip(counts, opens, strict=True)])
    later = [(c & (o > seen), _change(o, LINE, [0] * len(windows), item=_one(windows, i, 1))) for i, (c, o) in enumerate(zip(counts, opens, strict=True))]
    leave = [(c, _change(e, LINE, _one(windows, i, -1), F.col("n"), F.col("value"), _one(windows, i, -flag(k)))) for i, (c, e, k) in enumerate(zip(inside, ends, counts, strict=True))]
    return _changes(counted, (None, start), *later, *leave)


def _measures(windows: tuple[int, ...]) -> list[Measure]:
    kind = F.col("kind")
    out = [Measure("label", F.when(kind == LABEL, F.col("on0").cast("long") * F.col("n")).otherwise(F.lit(0).cast("long"))), Measure("last", F.col("last"), "max")]
    for i, d in enumerate(windows):
        n, value = F.col(f"on{i}").cast("long") * F.col("n"), F.col(f"on{i}").cast("long") * F.col("value")
        of = lambda what, *kinds: F.when(kind.isin(*kinds), what).otherwise(F.lit(0).cast("long"))
        columns = (of(n, CLICK, PURCHASE), of(n, PURCHASE), of(value, CLICK, PURCHASE), of(n, SALE), of(value, SALE), of(n, LINE), of(value, LINE), F.col(f"item{i}").cast("long"))
        out += [Measure(f"{name}_{d}", c) for name, c in zip(COUNTS, columns, strict=True)]
    return out


def features_at(sales: DataFrame, clicks: DataFrame, lines: DataFrame, probe: Column, windows: tuple[int, ...] = WINDOWS, delay: int = DELAY, ahead: int = AHEAD) -> DataFrame:
    """For each sale with a client and a time, and for each window of d days, what was known at its time ``t_us`` (microseconds: the sale's plus ``probe``).

    ``sale_id, d, t_us, label, n_clicks, n_purchases, click_cents, last_click_id, n_sales, sale_cents, n_lines, n_items, line_cents``.
    Events count from when they have arrived for ``delay``; those without client, time or arrival count for nothing (a sale without arrival
    still makes labels). Clicks equal in all columns count once, all other repeats each time; a repeated sale gives as many rows and
    its lines count for each of them. Amounts that are missing or not finite are 0. Lines without sale or shipping time don't count, those without item have no
    item. A null sale_id has ``probe`` taken as 0. Empty tables give no rows, or zeros; columns beside those named are read only to compare clicks.
    """
    held = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL")
    base = held.select("sale_id", "client_id", micros(sales, "sold_at").alias("sold"), micros(sales, "arrived_at").alias("came"), cents(F.col("total")).alias("value"), F.coalesce(probe.cast("long"), F.lit(0).cast("long")).alias("wait"))
    base = written(base.select("sale_id", "client_id", "sold", "value", "wait", F.when(F.col("came").isNotNull(), F.greatest("sold", F.col("came") + delay)).alias("seen")), "sales")
    # Each kind is written by itself: the fewer operators a stage has, the less its tasks report to the driver.
    parts = [write(part, "changes") for part in (_clicks(clicks, windows, delay), _sales(base, windows, ahead), _lines(lines, base, windows))]
    changes = sales.sparkSession.read.schema(parts[0][0].schema).parquet(*(path for _, path in parts))
    probes = base.groupBy("client_id", (F.col("sold") + F.col("wait")).alias("at"), "sale_id").agg(F.count(F.lit(1)).alias("times"))
    got = totals_until(changes, written(probes, "probes"), ["client_id"], _measures(windows))
    moved = F.expr(f"(last + {APART // 2}BD) div {APART}BD")
    named = got.withColumn("last_ts", moved - SHIFT).withColumn("last_id", (F.col("last") - moved.cast("decimal(20,0)") * F.lit(str(APART)).cast("decimal(20,0)")))
    last_id = F.when(F.col("last_id") != F.lit(str(NO_ID)).cast("decimal(20,0)"), F.col("last_id")).cast("long")
    each = [
        F.struct(F.lit(d).alias("d"), F.when(F.col("last_ts") > F.col("at") - d * DAY, last_id).alias("last_click_id"), *(F.col(f"{name}_{d}").alias(name) for name in COUNTS))
        for d in windows
    ]
    rows = named.select("sale_id", F.col("at").alias("t_us"), (F.col("label") > 0).alias("label"), F.explode(F.flatten(F.array_repeat(F.array(*each), F.col("times").cast("int")))).alias("w"))
    return rows.select("sale_id", "w.d", "t_us", "label", *(f"w.{c}" for c in ("n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")))
