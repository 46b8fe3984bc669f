"""Contracts of what goes to a scorer or an editor and what comes back: inputs, frozen cases, returned packets, logs, dispositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import namespaced_id, seed31, strip
from .checks import Violation


def input_problem(key: str, text: str) -> Column:
    """The first thing wrong with a row on its own: ``blank_key``, ``blank_text`` or ``newline``; null if nothing is."""
    empty = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    return F.when(empty(key), "blank_key").when(empty(text), "blank_text").when(F.col(text).rlike("[\r\n]"), "newline")


def scorer_input(df: DataFrame, key: str = "sent_id", group: str = "corpus_id", text: str = "text") -> DataFrame:
    """Exactly ``key, group, text`` and ``problem``: null for rows a scorer may get, else why not.

    A key that several rows hold is a ``duplicate`` in all of them. Other columns raise Violation. A null key is blank.
    """
    if df.columns != [key, group, text]:
        raise Violation(f"columns {df.columns} are not {[key, group, text]}")
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.count(F.lit(1)) > 1).alias("__again"))
    j = df.join(repeated, key, "left")
    return j.select(key, group, text, F.coalesce(input_problem(key, text), F.when(F.col("__again"), "duplicate")).alias("problem"))


def edit_cases(pairs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``pair_id, edit_type, original, edited, complete`` of an edit template; a blank edit is incomplete. Unknown types raise when read."""
    known = F.col("edit_type").isin(*kinds)
    kind = F.when(known, F.col("edit_type")).otherwise(F.raise_error(F.concat(F.lit("unknown edit type "), F.coalesce("edit_type", F.lit("null")))).cast("string"))
    pair_id = namespaced_id(F.col("case_id").cast("string"), F.col("slot").cast("string"), F.col("edit_type"))
    return pairs.select(pair_id.alias("pair_id"), kind.alias("edit_type"), "original", "edited", (F.coalesce(strip(F.col("edited")), F.lit("")) != "").alias("complete"))


def score_map(maps: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """``key, model_id, value, repeated``: maps of several judges in one table; ``repeated`` tells keys that one judge scored several times."""
    rows = None
    for name, m in maps.items():
        part = m.select(key, F.lit(name).alias("model_id"), value)
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy(key, "model_id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return rows.join(counts, [key, "model_id"])


def rehash(accepted: DataFrame, text: str, digest: str) -> DataFrame:
    """Rows whose stored digest is not that of their text; a null on either side is a violation."""
    return accepted.where(~F.coalesce(F.sha2(text, 256) == F.col(digest), F.lit(False)))


def replicates(groups: DataFrame, by: list[str], n: int, seed: str) -> DataFrame:
    """``by..., replicate, seed``: n numbered replicates of each group with the seed of its own stream; grows with the groups only."""
    out = groups.select(*by).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return out.withColumn("seed", seed31(F.lit(seed), *(F.col(b).cast("string") for b in by), F.col("replicate").cast("string")))


def return_audit(source: DataFrame, returned: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, problem`` of a returned packet: ``missing``, ``unknown``, ``repeated`` or ``changed``; one shuffle of key and digest.

    A key comes once, with the first problem that holds in that order. Null keys are one key.
    """
    rows = source.select(key, F.lit(1).alias("s"), F.lit(0).alias("r"), F.col(digest).alias("d")).unionByName(returned.select(key, F.lit(0).alias("s"), F.lit(1).alias("r"), F.col(digest).alias("d")))
    g = rows.groupBy(key).agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.min(F.coalesce("d", F.lit(""))).alias("low"), F.max(F.coalesce("d", F.lit(""))).alias("high"))
    problem = F.when(F.col("r") == 0, "missing").when(F.col("s") == 0, "unknown").when(F.col("r") > F.col("s"), "repeated").when(F.col("low") != F.col("high"), "changed")
    return g.select(key, problem.alias("problem")).where("problem is not null")


def completed(log: DataFrame, key: str, index: str, status: Column, last: tuple[str, ...]) -> DataFrame:
    """``key, rows, ended, complete``: a run is complete if its indexes are 1 to its rows and it reached one of the ``last`` states."""
    g = log.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.max(index).alias("top"), F.countDistinct(index).alias("different"), F.max(F.coalesce(status.isin(*last), F.lit(False))).alias("ended"))
    return g.select(key, "rows", "ended", (F.col("ended") & (F.col("top") == F.col("rows")) & (F.col("different") == F.col("rows"))).alias("complete"))


def chain_log(log: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The log with ``entry_sha256`` (of value and position) and ``previous_sha256`` (of the row before in its chain; null in the first)."""
    w = Window.partitionBy(*by).orderBy(order)
    own = F.sha2(F.concat_ws(":", F.col(order).cast("string"), F.col(value).cast("string")), 256)
    return log.withColumn("entry_sha256", own).withColumn("previous_sha256", F.lag("entry_sha256").over(w))


def tampered(log: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose stored entry no longer has its digest, or that don't follow the digest stored before them."""
    w = Window.partitionBy(*by).orderBy(order)
    own = F.sha2(F.concat_ws(":", F.col(order).cast("string"), F.col(value).cast("string")), 256)
    seen = log.withColumn("__before", F.lag("entry_sha256").over(w))
    return seen.where(~own.eqNullSafe(F.col("entry_sha256")) | ~F.col("__before").eqNullSafe(F.col("previous_sha256"))).drop("__before")


def lockstep(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two sorted files read in step: a full sort-merge join with ``side`` = both, left or right; memory does not grow with the files."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    j = a.join(b.hint("merge"), key, "full")
    return j.withColumn("side", F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left").otherwise("right")).drop("__l", "__r")


def disposition(bound: Column, failed: Column, waived: Column) -> Column:
    """accepted, waived or withheld of a row: its binding must hold; failed checks (array) must all be waived (array)."""
    open_ = F.size(F.array_except(failed, waived))
    return F.when(~F.coalesce(bound, F.lit(False)) | (open_ > 0), "withheld").when(F.size(failed) > 0, "waived").otherwise("accepted")


def replayed(first: DataFrame, second: DataFrame) -> DataFrame:
    """``rows, same``: whether two runs hold the same rows, however they are dealt or ordered; compared by sums of row digests."""
    cols = sorted(first.columns)
    mark = lambda d, s: d.select(F.xxhash64(*cols).alias("h"), F.lit(s).alias("s"))
    both = mark(first, 1).union(mark(second, -1)).groupBy("h").agg(F.sum("s").alias("d"), F.sum(F.when(F.col("s") == 1, 1).otherwise(0)).alias("n"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.bool_and(F.col("d") == 0), F.lit(True)).alias("same"))


def recomputed(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str], tolerance: float = 5e-9) -> DataFrame:
    """``keys..., column_name, a, b, within``: two computations of the same statistics; a value in one only is not within."""
    a = first.unpivot(keys, columns, "column_name", "a")
    b = second.unpivot(keys, columns, "column_name", "b")
    return a.join(b, [*keys, "column_name"], "full").select(*keys, "column_name", "a", "b", F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)).alias("within"))


def portable(path: Column, roots: tuple[str, ...]) -> Column:
    """A path without the host's folder before it; a path under none of the roots keeps its last part only."""
    out = F.element_at(F.split(path, "/"), -1)
    for root in sorted(roots, key=len):
        out = F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(out)
    return out
