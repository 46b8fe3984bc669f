"""Expectations: each gives the rows that violate it, so a gate is "this is empty"; and strict joins built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Violation(ValueError):
    """An expectation did not hold; nothing may be written."""


def require(violations: DataFrame, message: str) -> None:
    """Raise with a few of the violating rows, if there are any."""
    found = violations.limit(3).collect()
    if found:
        raise Violation(f"{message}: {[r.asDict() for r in found]}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """``keys..., n`` of keys with several rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.trim(column), F.lit("")) == "")


def out_of_bounds(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows whose value is missing, not finite or out of [low, high]."""
    v = F.col(value)
    return df.where(v.isNull() | F.isnan(v) | ~v.between(low, high))


def key_mismatch(tables: dict[str, DataFrame], *keys: str) -> DataFrame:
    """``keys..., present`` of keys that are not in every table, with the names of those that have them; one shuffle."""
    rows = None
    for name, t in tables.items():
        part = t.select(*keys, F.lit(name).alias("t"))
        rows = part if rows is None else rows.unionByName(part)
    have = rows.groupBy(*keys).agg(*(F.max(F.col("t") == n).alias(n) for n in tables))
    missing = F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in tables)), lambda x: x.isNotNull())
    return have.select(*keys, F.array_join(missing, ",").alias("present")).where(F.size(F.split("present", ",")) < len(tables))


def strict_join(tables: dict[str, DataFrame], *keys: str) -> DataFrame:
    """Inner join of tables whose keys must be unique and the same in all; raises Violation otherwise."""
    for name, t in tables.items():
        require(duplicates(t, *keys), f"duplicate keys in {name}")
    require(key_mismatch(tables, *keys), "keys are not the same in all tables")
    frames = list(tables.values())
    out = frames[0]
    for t in frames[1:]:
        out = out.join(t, list(keys))
    return out


def not_contiguous(df: DataFrame, key: str, index: str) -> DataFrame:
    """``key, rows, first, last, distinct_n``: keys whose indexes are not 1 to the number of their rows; sums only, no sort."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(index).alias("first"), F.max(index).alias("last"), F.countDistinct(index).alias("distinct_n"))
    return g.where("first <> 1 or last <> rows or distinct_n <> rows")


def after_accepted(df: DataFrame, key: str, index: str, accepted: Column) -> DataFrame:
    """Rows that follow an accepted one of the same key."""
    first = df.where(accepted).groupBy(key).agg(F.min(index).alias("__first"))
    return df.join(first, key).where(F.col(index) > F.col("__first")).drop("__first")


def broken_chain(log: DataFrame, order: str, own: str, previous: str, by: list[str]) -> DataFrame:
    """Rows that don't hold the hash of the row before; ``by`` keeps each chain to itself."""
    w = Window.partitionBy(*by).orderBy(order)
    return log.withColumn("__before", F.lag(own).over(w)).where(~F.col("__before").eqNullSafe(F.col(previous))).drop("__before")


def ordered_digest(df: DataFrame, value: str, order: list[str], by: list[str], block: int = 4096) -> DataFrame:
    """``by..., n, digest``: SHA-256 over the hashes of blocks of ``block`` values in order.

    ``order`` must start with an integer ordinal that numbers the group's rows from 0: blocks are
    cut by it, so no task holds more than a block of values.
    """
    part = df.withColumn("__b", F.floor(F.col(order[0]) / block))
    blocks = part.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]), "\n"), 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "h"))), lambda s: s["h"]), "\n")
    return blocks.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))


def baseline_gate(stats: DataFrame, baseline: DataFrame, key: str, columns: list[str], decimals: int = 3) -> DataFrame:
    """``key, column_ok..., ok``: whether each statistic rounds to its published value."""
    scale = 10.0**decimals
    near = lambda c: F.floor(F.col(c) * scale + 0.5)
    j = stats.join(F.broadcast(baseline.select(key, *(F.col(c).alias(f"p_{c}") for c in columns))), key)
    tests = {f"{c}_ok": near(c) == near(f"p_{c}") for c in columns}
    return j.select(key, *(t.alias(n) for n, t in tests.items())).withColumn("ok", F.forall(F.array(*tests), lambda x: x))


def private(df: DataFrame, forbidden: tuple[str, ...]) -> list[str]:
    """Columns that must not leave, by name; an export may go only if this is empty."""
    return [c for c in df.columns if any(f in c.lower() for f in forbidden)]


def blinded(df: DataFrame, allowed: tuple[str, ...], forbidden: tuple[str, ...]) -> DataFrame:
    """Only the allowed columns; raises Violation if one of them is forbidden."""
    out = df.select(*allowed)
    if bad := private(out, forbidden):
        raise Violation(f"forbidden columns: {bad}")
    return out
