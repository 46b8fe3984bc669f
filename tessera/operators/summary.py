"""Grouped summaries and distribution diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percentile, ratio
from ..sources.sinks import written
from .order import cumulative, quantiles

NINE = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def score_stats(scores: DataFrame, value: str = "score", by: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """Count, mean, median, population std, min, max, quartiles and their range."""
    by = list(by)
    scores = written(scores.select(*by, value), "scores")  # two narrow columns, read three times
    flat = scores.groupBy(*by).agg(F.count(value).alias("score_count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(scores, value, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return flat.join(q, by).withColumn("iqr", F.col("q3") - F.col("q1"))


def score_summary(scores: DataFrame, value: str = "score", by: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """The same with nine quantiles and the number of documents."""
    by = list(by)
    scores = written(scores.select(*by, "doc_path", value), "scores")
    flat = scores.groupBy(*by).agg(F.count(value).alias("n"), F.countDistinct("doc_path").alias("documents"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return flat.join(quantiles(scores, value, by, NINE), by).withColumn("iqr", F.col("q3") - F.col("q1"))


def edge_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin by comparison with the edges, the last one closed: agrees with an edge search where multiplication would not."""
    guess = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((value - low) / (high - low) * bins)))
    edge = lambda k: F.lit(low) + k * F.lit((high - low) / bins)
    down = F.when((guess > 0) & (value < edge(guess)), guess - 1).otherwise(guess)
    return F.when((down < bins - 1) & (value >= edge(down + 1)), down + 1).otherwise(down).cast("long")


def histogram(scores: DataFrame, value: str, by: tuple[str, ...], low: float = 0.0, high: float = 1.0, bins: int = 50, clamped: bool = False) -> DataFrame:
    """``by..., bin, n, share`` of every bin, empty ones too. clamped: bins by multiplication, as the pipeline's chart does."""
    by = list(by)
    where = F.least(F.lit(bins - 1), ((F.col(value) - low) / (high - low) * bins).cast("int")).cast("long") if clamped else edge_bin(F.col(value), low, high, bins)
    counts = scores.where(F.col(value).isNotNull()).groupBy(*by, where.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("total")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    return groups.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def distribution(scores: DataFrame, value: str, by: tuple[str, ...], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Spans, occupied and effective range, exact distinct count, tie rate, the mode (smallest on ties) and its share."""
    by = list(by)
    scores = written(scores.select(*by, value), "scores")
    counts = cumulative(scores, value, by)
    ties = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_values"), F.max("cum_total").alias("rows"), F.min(F.struct((-F.col("cum_n")).alias("m"), F.col(value).alias("v"))).alias("top"), F.min(value).alias("low"), F.max(value).alias("high"))
    q = quantiles(scores, value, by, {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95})
    out = ties.join(q, by).join(scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")), by)
    return out.select(
        *by, "rows", "distinct_values", (1 - F.col("distinct_values") / F.col("rows")).alias("tie_rate"), F.col("top.v").alias("mode_value"), (-F.col("top.m") / F.col("rows")).alias("mode_share"),
        "mean", "std", "median", (F.col("p95") - F.col("p05")).alias("span90"), (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("high") - F.col("low")).alias("occupied_range"),
        ((F.col("high") - F.col("low")) / (high - low)).alias("utilisation"), ((F.col("p95") - F.col("p05")) / (high - low)).alias("effective_dynamic_range"),
    )


def boundaries(scores: DataFrame, value: str, by: tuple[str, ...], low: float = 0.0, high: float = 1.0, fractions: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """Counts and shares within each fraction of the range at either end, the ends included; one pass over the rows."""
    v, span = F.col(value), high - low
    rows = scores.groupBy(*by).agg(F.count(value).alias("n"), *(F.count_if(v <= low + f * span).alias(f"l{i}") for i, f in enumerate(fractions)), *(F.count_if(v >= high - f * span).alias(f"h{i}") for i, f in enumerate(fractions)))
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("fraction"), F.col(f"l{i}").alias("low_n"), F.col(f"h{i}").alias("high_n")) for i, f in enumerate(fractions))))
    return rows.select(*by, "n", parts.alias("e")).select(*by, "e.fraction", "n", "e.low_n", "e.high_n", ratio(F.col("e.low_n"), F.col("n")).alias("low_share"), ratio(F.col("e.high_n"), F.col("n")).alias("high_share"))


def document_spans(scores: DataFrame, value: str, by: tuple[str, ...], doc: str = "doc_path", least: int = 20) -> DataFrame:
    """Mean over documents of at least ``least`` rows of the 5 to 95 % span within the document, each document equal."""
    inner = scores.groupBy(*by, doc).agg(F.count(value).alias("n"), (percentile(F.col(value), 0.95) - percentile(F.col(value), 0.05)).alias("span")).where(F.col("n") >= least)
    return inner.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.avg("span").alias("mean_span"))


def prevalence(decisions: DataFrame, codes: tuple[str, ...], by: tuple[str, ...] = ("corpus_id",), reasons: str = "reason_codes") -> DataFrame:
    """Rows with each reason, with its share of all and of removed rows; reasons without rows are there with 0."""
    by = list(by)
    counts = decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("all_rows"), F.count_if(F.size(reasons) > 0).alias("removed"), *(F.count_if(F.array_contains(reasons, c)).alias(c) for c in codes))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("reason"), F.col(c).alias("n")) for c in codes)))
    return counts.select(*by, "all_rows", "removed", each.alias("e")).select(*by, "e.reason", "e.n", ratio(F.col("e.n"), F.col("all_rows")).alias("share_all"), ratio(F.col("e.n"), F.col("removed")).alias("share_removed"))
