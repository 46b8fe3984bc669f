"""Registered queries of aggregates, ranks, samples, estimators and ladders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.numeric import correlation, percentile, q6, ratio
from ..operators import agreement, estimate, features, ladders, order, selection, summary
from ..sources.sinks import written
from .sentence_queries import _TF, DENSE, TOKENS
from .views import lit, sql, sql_q6, sql_uniform, sql_words

ALL: dict = {}
BY = ["corpus_id"]
REPS = 50


def query(name: str, text: str | None = None, **views: str):
    def add(make):
        ALL[name] = (make, sql(text, **views) if text else None)
        return make

    return add


def rounded(df, *keep: str):
    """All other columns that are doubles rounded to six decimals."""
    return df.select(*(q6(F.col(c)).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes))


def _q(p: float, x: str = "score") -> str:
    return f"quantile_cont({x}, {p})"


# --- aggregates ----------------------------------------------------------------------------------


@query("a5_corpus_stats", f"SELECT corpus_id, count(DISTINCT doc_path) AS documents, count(*) AS rows, {sql_q6('avg(n)')} AS token_mean, {sql_q6(_q(0.5, 'n'))} AS token_median, min(n) AS token_min, max(n) AS token_max, {sql_q6('avg(c)')} AS char_mean, {sql_q6(_q(0.5, 'c'))} AS char_median FROM (SELECT corpus_id, doc_path, CAST(len({sql_words('sent_text')}) AS BIGINT) AS n, CAST(length(sent_text) AS BIGINT) AS c FROM sentences) GROUP BY 1")
def _(v):
    s = v.sentences().select("corpus_id", "doc_path", X.token_count(F.col("sent_text")).alias("n"), F.length("sent_text").cast("long").alias("c"))
    # Lengths are few different values, so exact percentiles hold little.
    g = s.groupBy("corpus_id").agg(F.countDistinct("doc_path").alias("documents"), F.count(F.lit(1)).alias("rows"), F.avg("n").alias("token_mean"), percentile(F.col("n"), 0.5).alias("token_median"), F.min("n").alias("token_min"), F.max("n").alias("token_max"), F.avg("c").alias("char_mean"), percentile(F.col("c"), 0.5).alias("char_median"))
    return rounded(g)


@query("a6_score_stats", f"SELECT corpus_id, count(*) AS score_count, {sql_q6('avg(score)')} AS mean, {sql_q6(_q(0.5))} AS median, {sql_q6('stddev_pop(score)')} AS std, {sql_q6('min(score)')} AS min, {sql_q6('max(score)')} AS max, {sql_q6(_q(0.25))} AS q1, {sql_q6(_q(0.75))} AS q3, {sql_q6(_q(0.75) + ' - ' + _q(0.25))} AS iqr FROM strict WHERE keep GROUP BY 1")
def _(v):
    return rounded(summary.score_stats(v.strict().where("keep").select("corpus_id", "score")))


@query("a7_summary", f"SELECT corpus_id, count(*) AS n, count(DISTINCT doc_path) AS documents, {sql_q6('avg(score)')} AS mean, {sql_q6('stddev_pop(score)')} AS std, {sql_q6('min(score)')} AS min, {sql_q6('max(score)')} AS max, " + ", ".join(f"{sql_q6(_q(p))} AS {k}" for k, p in summary.NINE.items()) + f", {sql_q6(_q(0.75) + ' - ' + _q(0.25))} AS iqr FROM scores GROUP BY 1")
def _(v):
    return rounded(summary.score_summary(v.scores().select("corpus_id", "doc_path", "score")))


_LENGTHS = {f"t{int(p * 100):02d}": p for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}


@query("a8_length_distribution", f"SELECT variant, corpus_id, count(*) AS n, count(DISTINCT doc_path) AS documents, {sql_q6('avg(t)')} AS mean, {sql_q6('stddev_pop(t)')} AS std, min(t) AS least, max(t) AS most, " + ", ".join(f"{sql_q6(_q(p, 't'))} AS {k}" for k, p in _LENGTHS.items()) + ", " + ", ".join(f"{sql_q6(_q(p, 'c'))} AS c{int(p * 100)}" for p in (0.25, 0.5, 0.75)) + " FROM (SELECT corpus_id, doc_path, CAST(ntok AS BIGINT) AS t, CAST(length(sent_text) AS BIGINT) AS c, unnest(CASE WHEN keep THEN ['original', 'strict'] ELSE ['original'] END) AS variant FROM strict) GROUP BY 1, 2")
def _(v):
    s = v.strict().select("corpus_id", "doc_path", F.col("token_count").alias("t"), F.length("sent_text").cast("long").alias("c"), F.explode(F.array_compact(F.array(F.lit("original"), F.when(F.col("keep"), "strict")))).alias("variant"))
    p = percentile(F.col("t"), list(_LENGTHS.values()))
    c = percentile(F.col("c"), [0.25, 0.5, 0.75])
    g = s.groupBy("variant", "corpus_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_path").alias("documents"), F.avg("t").alias("mean"), F.stddev_pop("t").alias("std"), F.min("t").alias("least"), F.max("t").alias("most"), p.alias("p"), c.alias("q"))
    return rounded(g.select("variant", "corpus_id", "n", "documents", "mean", "std", "least", "most", *(F.col("p")[i].alias(k) for i, k in enumerate(_LENGTHS)), *(F.col("q")[i].alias(f"c{k}") for i, k in enumerate((25, 50, 75)))))


def _hist_sql(where: str) -> str:
    return f"SELECT g.corpus_id AS corpus_id, CAST(g.bin AS BIGINT) AS bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n, {sql_q6('coalesce(c.n, 0) / CAST(g.total AS DOUBLE)')} AS share FROM (SELECT corpus_id, total, unnest(range(0, 50)) AS bin FROM (SELECT corpus_id, count(*) AS total FROM scores GROUP BY 1)) g LEFT JOIN (SELECT corpus_id, {where} AS bin, count(*) AS n FROM scores GROUP BY 1, 2) c ON g.corpus_id = c.corpus_id AND g.bin = c.bin"


@query("a9_histogram", _hist_sql("CASE WHEN score >= 49 * CAST(0.02 AS DOUBLE) THEN 49 ELSE CAST(floor(score * 50) AS INTEGER) - CAST(score < floor(score * 50) * CAST(0.02 AS DOUBLE) AS INTEGER) + CAST(score >= (floor(score * 50) + 1) * CAST(0.02 AS DOUBLE) AS INTEGER) END"))
def _(v):
    return rounded(summary.histogram(v.scores(), "score", ("corpus_id",)))


@query("a9_histogram_clamped", _hist_sql("least(49, CAST(floor(score * 50) AS INTEGER))"))
def _(v):
    return rounded(summary.histogram(v.scores(), "score", ("corpus_id",), clamped=True))


@query("a10_distribution", f"""SELECT corpus_id, count(*) AS rows, count(DISTINCT percent) AS distinct_values, {sql_q6('1 - count(DISTINCT percent) / CAST(count(*) AS DOUBLE)')} AS tie_rate, {sql_q6('any_value(mode)')} AS mode_value, {sql_q6('any_value(mode_n) / CAST(count(*) AS DOUBLE)')} AS mode_share,
    {sql_q6('avg(percent)')} AS mean, {sql_q6('stddev_pop(percent)')} AS std, {sql_q6(_q(0.5, 'percent'))} AS median, {sql_q6(_q(0.95, 'percent') + ' - ' + _q(0.05, 'percent'))} AS span90, {sql_q6(_q(0.75, 'percent') + ' - ' + _q(0.25, 'percent'))} AS iqr, {sql_q6('max(percent) - min(percent)')} AS occupied_range, {sql_q6('(max(percent) - min(percent)) / 100')} AS utilisation, {sql_q6('(' + _q(0.95, 'percent') + ' - ' + _q(0.05, 'percent') + ') / 100')} AS effective_dynamic_range
    FROM scores JOIN modes USING (corpus_id) GROUP BY 1""", modes="SELECT corpus_id, percent AS mode, n AS mode_n FROM (SELECT corpus_id, percent, count(*) AS n, row_number() OVER (PARTITION BY corpus_id ORDER BY count(*) DESC, percent) AS r FROM scores GROUP BY 1, 2) WHERE r = 1")
def _(v):
    return rounded(summary.distribution(v.scores().select("corpus_id", "percent"), "percent", ("corpus_id",), 0.0, 100.0))


@query("a11_boundary", f"SELECT corpus_id, fraction, count(*) AS n, count(*) FILTER (score <= 0 + fraction) AS low_n, count(*) FILTER (score >= 1 - fraction) AS high_n, {sql_q6('count(*) FILTER (score <= fraction) / CAST(count(*) AS DOUBLE)')} AS low_share, {sql_q6('count(*) FILTER (score >= 1 - fraction) / CAST(count(*) AS DOUBLE)')} AS high_share FROM (SELECT corpus_id, score, unnest([CAST(0.01 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE)]) AS fraction FROM scores) GROUP BY 1, 2")
def _(v):
    return rounded(summary.boundaries(v.scores(), "score", ("corpus_id",)), "fraction").select("corpus_id", "fraction", "n", "low_n", "high_n", "low_share", "high_share")


_CODES = ", ".join(map(lit, P.STRICT_REASONS))


@query("a12_prevalence", f"SELECT corpus_id, reason, count(*) FILTER (list_contains(reason_codes, reason)) AS n, {sql_q6('count(*) FILTER (list_contains(reason_codes, reason)) / CAST(count(*) AS DOUBLE)')} AS share_all, {sql_q6('count(*) FILTER (list_contains(reason_codes, reason)) / CAST(nullif(count(*) FILTER (NOT keep), 0) AS DOUBLE)')} AS share_removed FROM (SELECT corpus_id, reason_codes, keep, unnest([{_CODES}]) AS reason FROM strict) GROUP BY 1, 2")
def _(v):
    return rounded(summary.prevalence(v.strict(), P.STRICT_REASONS))


@query("a13_overlap", "SELECT corpus_id, len(reason_codes) AS reasons, count(*) AS n FROM strict GROUP BY 1, 2")
def _(v):
    return v.strict().groupBy("corpus_id", F.size("reason_codes").cast("long").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("a14_strata", f"SELECT CAST(metric AS VARCHAR) AS metric, edit_type, count(*) AS n, {sql_q6('avg(delta)')} AS mean FROM candidates GROUP BY GROUPING SETS ((), (metric), (edit_type))")
def _(v):
    c = v.candidates()
    return c.groupingSets([[], [c.metric], [c.edit_type]], c.metric, c.edit_type).agg(F.count(F.lit(1)).alias("n"), q6(F.avg("delta")).alias("mean"))


@query("a15_document_span", f"SELECT corpus_id, count(*) AS documents, {sql_q6('avg(span)')} AS mean_span FROM (SELECT corpus_id, doc_path, {_q(0.95)} - {_q(0.05)} AS span FROM scores GROUP BY 1, 2 HAVING count(*) >= 20) GROUP BY 1")
def _(v):
    return rounded(summary.document_spans(v.scores(), "score", ("corpus_id",)))


@query("a16_rates", f"SELECT corpus_id, {sql_q6('avg(CAST(keep AS INTEGER))')} AS retention, {sql_q6('avg(CAST(score >= 0.5 AS INTEGER))')} AS upper_half, {sql_q6('avg(CAST(abs(score - score2) <= 0.1 AS INTEGER))')} AS within_tenth FROM strict GROUP BY 1")
def _(v):
    share = lambda c: q6(F.avg(c.cast("int")))
    return v.strict().groupBy("corpus_id").agg(share(F.col("keep")).alias("retention"), share(F.col("score") >= 0.5).alias("upper_half"), share(F.abs(F.col("score") - F.col("score2")) <= 0.1).alias("within_tenth"))


_KINDS = ", ".join(map(lit, P.EDIT_TYPES))


@query("a17_edit_summary", f"SELECT k.edit_type AS edit_type, count(delta) AS n, {sql_q6('avg(delta)')} AS mean, {sql_q6(_q(0.5, 'delta'))} AS median, {sql_q6('avg(abs(delta))')} AS mean_abs, {sql_q6(_q(0.25, 'delta'))} AS q25, {sql_q6(_q(0.75, 'delta'))} AS q75, {sql_q6('100 * avg(CAST(CASE k.edit_type WHEN ' + lit('add_specific') + ' THEN delta > 0 WHEN ' + lit('de_specify') + ' THEN delta < 0 END AS INTEGER))')} AS directional FROM (SELECT unnest([{_KINDS}]) AS edit_type) k LEFT JOIN candidates c ON c.edit_type = k.edit_type AND c.metric = 'a' GROUP BY 1")
def _(v):
    kinds = v.spark.createDataFrame([(k,) for k in P.EDIT_TYPES], "edit_type string")
    d = kinds.join(v.candidates().where("metric = 'a'"), "edit_type", "left")
    ok = agreement.consistent_direction(F.col("delta"), F.col("edit_type"))
    return rounded(d.groupBy("edit_type").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), percentile(F.col("delta"), 0.5).alias("median"), F.avg(F.abs("delta")).alias("mean_abs"), percentile(F.col("delta"), 0.25).alias("q25"), percentile(F.col("delta"), 0.75).alias("q75"), (100 * F.avg(ok.cast("int"))).alias("directional")))


@query("a18_pair_delta", f"SELECT edit_type, scope, count(*) AS n, {sql_q6('avg(d)')} AS mean, {sql_q6(_q(0.5, 'd'))} AS median, {sql_q6('avg(CAST(abs(d) <= 0.05 AS INTEGER))')} AS near_zero FROM (SELECT edit_type, d, unnest(CASE WHEN regexp_matches(original, '[0-9]') THEN ['all', 'units'] ELSE ['all'] END) AS scope FROM (SELECT edit_type, original, {sql_uniform('edited')} - {sql_uniform('original')} AS d FROM pairs)) GROUP BY 1, 2")
def _(v):
    d = v.pairs().select("edit_type", (X.uniform(F.col("edited")) - X.uniform(F.col("original"))).alias("d"), F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("original").rlike("[0-9]"), "units")))).alias("scope"))
    return rounded(d.groupBy("edit_type", "scope").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), percentile(F.col("d"), 0.5).alias("median"), F.avg((F.abs("d") <= 0.05).cast("int")).alias("near_zero")))


@query("a19_levels", f"SELECT k.level AS level, count(r.rating) AS n, {sql_q6('count(r.rating) / CAST((SELECT count(*) FROM reviews) AS DOUBLE)')} AS share FROM (SELECT unnest(['0', '1', '2', '3', '4', '5', 'X']) AS level) k LEFT JOIN reviews r ON r.rating = k.level GROUP BY 1")
def _(v):
    levels = v.spark.createDataFrame([(x,) for x in "012345X"], "level string")
    counts = v.reviews().groupBy(F.col("rating").alias("level")).agg(F.count(F.lit(1)).alias("c"))
    all_ = counts.agg(F.sum("c").alias("all"))
    return levels.join(counts, "level", "left").join(F.broadcast(all_)).select("level", F.coalesce("c", F.lit(0)).alias("n"), q6(F.coalesce("c", F.lit(0)) / F.col("all")).alias("share"))


@query("a20_label_distribution", "SELECT annotator, string_agg(label || ':' || n, ' ' ORDER BY label) AS counts, CAST(sum(n) AS BIGINT) AS present, CAST(max(missing) AS BIGINT) AS missing FROM (SELECT annotator, label, count(label) AS n, 0 AS missing FROM annotators WHERE label IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT annotator, NULL, 0, count(*) FILTER (label IS NULL) FROM annotators GROUP BY 1) GROUP BY 1")
def _(v):
    a = v.annotators().groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("n"))
    held = F.col("label").isNotNull()
    g = a.groupBy("annotator").agg(F.array_sort(F.collect_list(F.when(held, F.struct("label", "n")))).alias("c"), F.sum(F.when(held, F.col("n"))).alias("present"), F.coalesce(F.sum(F.when(~held, F.col("n"))), F.lit(0)).alias("missing"))
    return g.select("annotator", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["label"].cast("string"), x["n"].cast("string"))), " ").alias("counts"), "present", "missing")


_WIDE = {"wide": "SELECT sent_id, any_value(corpus_id) AS corpus_id, max(label) FILTER (annotator = 'ann1') AS a, max(label) FILTER (annotator = 'ann2') AS b, max(label) FILTER (annotator = 'ann3') AS c, avg(label) AS label_mean, stddev_pop(label) AS label_sd, count(label) AS present FROM annotators GROUP BY 1"}


def _wide(v):
    return v.annotators().groupBy("sent_id").agg(F.max("corpus_id").alias("corpus_id"), *(F.max(F.when(F.col("annotator") == n, F.col("label"))).alias(k) for k, n in (("a", "ann1"), ("b", "ann2"), ("c", "ann3"))), F.avg("label").alias("label_mean"), F.stddev_pop("label").alias("label_sd"), F.count("label").alias("present"))


@query("a21_trend", f"SELECT {sql_q6('label_mean')} AS label_mean, count(*) AS n, {sql_q6('avg(' + sql_uniform('sent_id') + ')')} AS mean_score FROM wide WHERE label_mean IS NOT NULL GROUP BY 1", **_WIDE)
def _(v):
    return _wide(v).where("label_mean is not null").groupBy(q6(F.col("label_mean")).alias("label_mean")).agg(F.count(F.lit(1)).alias("n"), q6(F.avg(X.uniform(F.col("sent_id")))).alias("mean_score"))


@query("a22_rowwise", f"SELECT sent_id, {sql_q6('label_mean')} AS label_mean, {sql_q6('label_sd')} AS label_sd, present FROM wide", **_WIDE)
def _(v):
    return _wide(v).select("sent_id", q6(F.col("label_mean")).alias("label_mean"), q6(F.col("label_sd")).alias("label_sd"), "present")


@query("a23_decimal_mean", "SELECT corpus_id, count(*) AS n, count(DISTINCT (CAST(floor(score * 100) AS BIGINT) + CAST(floor(score2 * 100) AS BIGINT) + CAST(floor(score3 * 100) AS BIGINT))) AS distinct_means FROM scores GROUP BY 1")
def _(v):
    d = lambda c: (F.floor(F.col(c) * 100) / 100).cast("decimal(38,18)")
    mean = ((d("score") + d("score2") + d("score3")) / 3).cast("decimal(38,18)")
    return v.scores().select("corpus_id", mean.alias("m")).groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("m").alias("distinct_means"))


@query("a24_run_variability", f"SELECT corpus_id, {sql_q6('min(m)')} AS least, {sql_q6('max(m)')} AS most, {sql_q6('max(m) - min(m)')} AS range, {sql_q6('stddev_pop(m)')} AS sd FROM (SELECT corpus_id, run, avg(x) AS m FROM (SELECT corpus_id, unnest([1, 2, 3]) AS run, unnest([score, score2, score3]) AS x FROM scores) GROUP BY 1, 2) GROUP BY 1")
def _(v):
    runs = v.scores().groupBy("corpus_id").agg(F.avg("score").alias("a"), F.avg("score2").alias("b"), F.avg("score3").alias("c")).unpivot("corpus_id", ["a", "b", "c"], "run", "m")
    return rounded(runs.groupBy("corpus_id").agg(F.min("m").alias("least"), F.max("m").alias("most"), (F.max("m") - F.min("m")).alias("range"), F.stddev_pop("m").alias("sd")))


@query("a25_coverage", f"SELECT edit_type, count(*) AS planned, count(*) FILTER (delta > 0) AS accepted, {sql_q6('count(*) FILTER (delta > 0) / CAST(count(*) AS DOUBLE)')} AS rate, min(count(*) FILTER (delta > 0)) OVER () AS least_cell FROM candidates WHERE metric = 'a' GROUP BY 1")
def _(v):
    g = v.candidates().where("metric = 'a'").groupBy("edit_type").agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("delta") > 0).alias("accepted"))
    return g.join(F.broadcast(g.agg(F.min("accepted").alias("least_cell")))).select("edit_type", "planned", "accepted", q6(ratio(F.col("accepted"), F.col("planned"))).alias("rate"), "least_cell")


@query("a26_failures", "SELECT corpus_id, reason, count(*) AS n FROM (SELECT corpus_id, unnest(reason_codes) AS reason FROM strict WHERE NOT keep) GROUP BY 1, 2")
def _(v):
    return v.strict().where("not keep").select("corpus_id", F.explode("reason_codes").alias("reason")).groupBy("corpus_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("a27_confusion", f"SELECT lang, count(*) AS n, 0::BIGINT AS abstained, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn, {sql_q6('count(*) FILTER (quality = 1 AND toxic <> 0) / CAST(nullif(count(*) FILTER (toxic <> 0), 0) AS DOUBLE)')} AS far, {sql_q6('count(*) FILTER (quality <> 1 AND toxic = 0) / CAST(nullif(count(*) FILTER (toxic = 0), 0) AS DOUBLE)')} AS frr FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(v):
    d = v.table("labels").join(v.table("documents").select("doc_id", "lang"), "doc_id")
    return rounded(agreement.confusion(d, F.col("quality") == 1, F.col("toxic") == 0, ["lang"]))


_DELTA = "CASE WHEN rating = 'X' THEN NULL ELSE (3 - CAST(replace(rating, 'X', '0') AS INTEGER)) * CASE WHEN side = 'A' THEN 1 ELSE -1 END END"
_OUT = {
    "outcome": f"SELECT *, {_DELTA} AS d FROM reviews",
    "judged": "SELECT *, coalesce(CASE edit_type WHEN 'add_specific' THEN d > 0 WHEN 'de_specify' THEN d < 0 ELSE d = 0 END, false) AS valid, CASE edit_type WHEN 'add_specific' THEN d WHEN 'de_specify' THEN -d ELSE -abs(d) END AS utility FROM outcome",
}


def _judged(v):
    r = v.reviews().withColumn("d", agreement.review_delta(F.col("rating"), F.col("side")))
    return r.withColumns({"valid": agreement.direction_valid(F.col("d"), F.col("edit_type")), "utility": agreement.utility(F.col("d"), F.col("edit_type"))})


@query("a28_case_summary", f"SELECT case_id, {sql_q6('avg(CAST(valid AS INTEGER))')} AS valid_share, {sql_q6('avg(CAST(d IS NULL AS INTEGER))')} AS x_share, {sql_q6('avg(utility)')} AS mean_utility FROM judged GROUP BY 1", **_OUT)
def _(v):
    return rounded(_judged(v).groupBy("case_id").agg(F.avg(F.col("valid").cast("int")).alias("valid_share"), F.avg(F.col("d").isNull().cast("int")).alias("x_share"), F.avg("utility").alias("mean_utility")))


@query("a29_win_loss_tie", "SELECT a.edit_type AS edit_type, count(*) FILTER (a.utility > b.utility) AS wins, count(*) FILTER (a.utility < b.utility) AS losses, count(*) FILTER (a.utility = b.utility) AS ties FROM judged a JOIN judged b ON a.case_id = b.case_id AND a.slot = 0 AND b.slot = 1 GROUP BY 1", **_OUT)
def _(v):
    j = _judged(v)
    a, b = (j.where(F.col("slot") == s).select("case_id", "edit_type", F.col("utility").alias(n)) for s, n in ((0, "u"), (1, "w")))
    u, w = F.col("u"), F.col("w")
    return a.join(b.drop("edit_type"), "case_id").groupBy("edit_type").agg(F.count_if(u > w).alias("wins"), F.count_if(u < w).alias("losses"), F.count_if(u == w).alias("ties"))


@query("a30_metric_quantiles", "SELECT edit_type, metric, " + ", ".join(f"{sql_q6(_q(p, 'delta'))} AS {k}" for k, p in (("least", 0.0), ("q10", 0.1), ("median", 0.5), ("q90", 0.9), ("most", 1.0))) + " FROM candidates GROUP BY 1, 2")
def _(v):
    g = v.candidates().groupBy("edit_type", "metric").agg(percentile(F.col("delta"), [0.0, 0.1, 0.5, 0.9, 1.0]).alias("p"))
    return rounded(g.select("edit_type", "metric", *(F.col("p")[i].alias(k) for i, k in enumerate(("least", "q10", "median", "q90", "most")))))


@query("a31_latency", f"SELECT event_type, {sql_q6(_q(0.5, 'value'))} AS p50, {sql_q6('quantile_disc(value, 0.95)')} AS p95 FROM events GROUP BY 1")
def _(v):
    return v.table("events").groupBy("event_type").agg(q6(percentile(F.col("value"), 0.5)).alias("p50"), q6(F.expr("percentile_disc(0.95) within group (order by value)")).alias("p95"))


@query("a32_examples", "SELECT reason, sent_id, position FROM (SELECT reason, sent_id, row_number() OVER (PARTITION BY reason ORDER BY doc_path, sent_idx, sent_id) AS position FROM (SELECT doc_path, sent_idx, sent_id, unnest(reason_codes) AS reason FROM strict)) WHERE position <= 5")
def _(v):
    d = v.strict().select("doc_path", "sent_idx", "sent_id", F.explode("reason_codes").alias("reason"))
    return selection.top(d, 5, ["doc_path", "sent_idx", "sent_id"], ["reason"]).select("reason", "sent_id", F.col("position").cast("long").alias("position"))


@query("a33_stratum_counts", "SELECT edit_type, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) % 2 = 0 AS even FROM candidates GROUP BY 1")
def _(v):
    g = v.candidates().groupBy("edit_type").agg(F.countDistinct("case_id").alias("cases"))
    return g.select("edit_type", "cases", (F.col("cases") % 2 == 0).alias("even"))


# --- ranks and samples ---------------------------------------------------------------------------

_AVG = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def _rank(x: str, by: str = "corpus_id") -> str:
    return "(" + _AVG.format(by=by, x=x) + ")"


@query("w1_avg_rank", f"SELECT corpus_id, sent_id, CAST({_rank('percent')} AS DOUBLE) AS rank FROM scores")
def _(v):
    return order.average_rank(v.scores().select("corpus_id", "sent_id", "percent"), "percent", BY).select("corpus_id", "sent_id", "rank")


@query("w2_mid_rank", f"SELECT corpus_id, sent_id, {sql_q6('(' + _rank('percent') + ' - 0.5) / count(*) OVER (PARTITION BY corpus_id)')} AS mid_rank FROM scores")
def _(v):
    return rounded(order.mid_rank(v.scores().select("corpus_id", "sent_id", "percent"), "percent", BY).select("corpus_id", "sent_id", "mid_rank"))


_PROXY = "(" + " + ".join(_rank(c) for c in ("percent", "n", "score2")) + ") / 3.0 / count(*) OVER (PARTITION BY corpus_id)"
SIZED = {"lengths": f"SELECT *, CAST(len({sql_words('sent_text')}) AS BIGINT) AS n FROM scores", "proxied": f"SELECT *, {sql_q6(_PROXY)} AS proxy_index FROM lengths"}


def _proxied(v):
    s = v.scores().select("corpus_id", "sent_id", "sent_text", "percent", "score", "score2", X.token_count(F.col("sent_text")).alias("n"))
    s = written(s.drop("sent_text"), "proxies")
    return selection.proxy_index(s, ["percent", "n", "score2"], BY).withColumn("proxy_index", q6(F.col("proxy_index")))


@query("w3_proxy_index", "SELECT corpus_id, sent_id, proxy_index FROM proxied", **SIZED)
def _(v):
    return _proxied(v).select("corpus_id", "sent_id", "proxy_index")


_EDGE = "CASE WHEN row_number() OVER (PARTITION BY corpus_id ORDER BY {x}, sent_id) <= greatest(1, count(*) OVER (PARTITION BY corpus_id) // {k}) THEN 'low' WHEN row_number() OVER (PARTITION BY corpus_id ORDER BY {x}, sent_id) > count(*) OVER (PARTITION BY corpus_id) - greatest(1, count(*) OVER (PARTITION BY corpus_id) // {k}) THEN 'high' ELSE 'mid' END"


def _edge(x: str, k: int = 4) -> str:
    return _EDGE.format(x=x, k=k)


@query("w4_quartiles", f"SELECT corpus_id, sent_id, {_edge('percent')} AS quarter FROM scores")
def _(v):
    return selection.edges(v.scores().select("corpus_id", "sent_id", "percent"), "percent", "sent_id", BY, "quarter").select("corpus_id", "sent_id", "quarter")


@query("w5_quintiles", f"SELECT corpus_id, quintile, count(*) AS n, {sql_q6('avg(percent)')} AS mean FROM (SELECT s.corpus_id, percent, len(list_filter(edges, lambda e: e < percent)) AS quintile FROM scores s JOIN cuts USING (corpus_id)) GROUP BY 1, 2", cuts="SELECT corpus_id, list_filter(list_distinct(e), lambda x: x > lo) AS edges FROM (SELECT corpus_id, min(percent) AS lo, quantile_cont(percent, [0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM scores GROUP BY 1)")
def _(v):
    s = v.scores().select("corpus_id", "percent")
    cuts = order.quantiles(s, "percent", BY, {f"e{i}": i / 5 for i in range(6)})
    cuts = cuts.select("corpus_id", F.filter(F.array_distinct(F.array(*(F.col(f"e{i}") for i in range(1, 6)))), lambda x: x > F.col("e0")).alias("edges"))
    d = s.join(F.broadcast(cuts), "corpus_id").withColumn("quintile", F.size(F.filter("edges", lambda e: e < F.col("percent"))).cast("long"))
    return d.groupBy("corpus_id", "quintile").agg(F.count(F.lit(1)).alias("n"), q6(F.avg("percent")).alias("mean"))


@query("w6_position_bins", f"SELECT corpus_id, bin, count(*) AS n, {sql_q6('avg(percent)')} AS x, {sql_q6('avg(score)')} AS y FROM (SELECT corpus_id, percent, score, least(19, (row_number() OVER (PARTITION BY corpus_id ORDER BY percent, sent_id) - 1) * 20 // count(*) OVER (PARTITION BY corpus_id)) AS bin FROM scores) GROUP BY 1, 2")
def _(v):
    d = selection.edges(v.scores().select("corpus_id", "sent_id", "percent", "score"), "percent", "sent_id", BY, "e")
    d = d.withColumn("bin", F.least(F.lit(19), F.floor((F.col("e_position") - 1) * 20 / F.col("e_total"))).cast("long"))
    return d.groupBy("corpus_id", "bin").agg(F.count(F.lit(1)).alias("n"), q6(F.avg("percent")).alias("x"), q6(F.avg("score")).alias("y"))


_KEYED = "CASE edit_type WHEN 'add_specific' THEN -delta WHEN 'de_specify' THEN delta ELSE abs(delta) END"


@query("w7_consensus", f"SELECT case_id, slot, rank_sum FROM (SELECT case_id, slot, CAST(sum(r) AS BIGINT) AS rank_sum, row_number() OVER (PARTITION BY case_id ORDER BY sum(r), slot) AS k FROM (SELECT case_id, slot, row_number() OVER (PARTITION BY case_id, metric ORDER BY {_KEYED}, slot) AS r FROM candidates) GROUP BY 1, 2) WHERE k = 1")
def _(v):
    return selection.consensus(v.candidates(), "delta", "edit_type", "metric")


@query("w8_best_of_n", f"SELECT case_id, metric, slot FROM (SELECT case_id, metric, slot, row_number() OVER (PARTITION BY case_id, metric ORDER BY {_KEYED}, slot) AS r FROM candidates) WHERE r = 1")
def _(v):
    return selection.best_of_n(v.candidates(), by=("metric",)).select("case_id", "metric", "slot")


@query("w9_segments", "SELECT CASE WHEN position <= n / 3.0 THEN 'first' WHEN position > 2 * n / 3.0 THEN 'final' ELSE 'middle' END AS segment, rating, count(*) AS n FROM (SELECT rating, row_number() OVER (ORDER BY sha256('packet:' || concat_ws('-', case_id, slot))) AS position, count(*) OVER () AS n FROM reviews) GROUP BY 1, 2")
def _(v):
    r = v.reviews().select("rating", F.concat_ws("-", "case_id", "slot").alias("k"))
    d = selection.packet_order(r, "k", "packet")
    d = d.join(F.broadcast(r.agg(F.count(F.lit(1)).alias("rows"))))
    p, n = F.col("position"), F.col("rows")
    return d.groupBy(F.when(p <= n / 3, "first").when(p > 2 * n / 3, "final").otherwise("middle").alias("segment"), "rating").agg(F.count(F.lit(1)).alias("n"))


@query("w10_ordering", "SELECT string_agg(corpus_id, ' > ' ORDER BY a DESC, corpus_id) AS by_all, string_agg(corpus_id, ' > ' ORDER BY b DESC, corpus_id) AS by_strict FROM (SELECT corpus_id, avg(score) AS a, avg(score) FILTER (keep) AS b FROM strict GROUP BY 1)")
def _(v):
    g = v.strict().groupBy("corpus_id").agg(F.avg("score").alias("a"), F.avg(F.when(F.col("keep"), F.col("score"))).alias("b"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("k"), "corpus_id"))), lambda s: s["corpus_id"]), " > ")
    return g.agg(listed("a").alias("by_all"), listed("b").alias("by_strict"))


@query("w11_disagreement", f"SELECT corpus_id, sent_id, difference, position FROM (SELECT corpus_id, sent_id, difference, row_number() OVER (PARTITION BY corpus_id ORDER BY difference DESC, sent_id) AS position FROM (SELECT corpus_id, sent_id, {sql_q6('abs(' + _rank('score') + ' - ' + _rank('percent') + ') / count(*) OVER (PARTITION BY corpus_id)')} AS difference FROM scores)) WHERE position <= 25")
def _(v):
    d = order.mid_ranks(v.scores().select("corpus_id", "sent_id", "score", "percent"), {"score": "a", "percent": "b"}, BY)
    d = d.select("corpus_id", "sent_id", q6(F.abs(F.col("a") - F.col("b"))).alias("difference"))
    return selection.top(d, 25, [F.desc("difference"), F.col("sent_id")], BY).select("corpus_id", "sent_id", "difference", F.col("position").cast("long").alias("position"))


@query("w17_weighted_quantile", "SELECT corpus_id, min(n) FILTER (upto >= 0.275 * total) AS q275, min(n) FILTER (upto >= 0.5 * total) AS q500 FROM (SELECT corpus_id, n, sum(w) OVER (PARTITION BY corpus_id ORDER BY n) AS upto, sum(w) OVER (PARTITION BY corpus_id) AS total FROM (SELECT corpus_id, n, count(*) AS w FROM lengths GROUP BY 1, 2)) GROUP BY 1", **SIZED)
def _(v):
    c = order.cumulative(v.scores().select("corpus_id", X.token_count(F.col("sent_text")).alias("length")), "length", BY)
    at = lambda p: F.min(F.when(F.col("cum_before") + F.col("cum_n") >= p * F.col("cum_total"), F.col("length")))
    return c.groupBy("corpus_id").agg(at(0.275).alias("q275"), at(0.5).alias("q500"))


_DIV = {
    "placed": f"SELECT corpus_id, sent_id, score, {_edge('score')} AS s, {_edge('proxy_index')} AS p, row_number() OVER (PARTITION BY corpus_id ORDER BY score, sent_id) AS pos, count(*) OVER (PARTITION BY corpus_id) AS total FROM proxied",
    "mids": "SELECT corpus_id, score AS mid FROM placed WHERE pos - 1 = total // 2",
} | SIZED


def _top(bucket: str, where: str, by: str, tail: str = "placed") -> str:
    return f"SELECT corpus_id, '{bucket}' AS bucket, sent_id, position FROM (SELECT corpus_id, sent_id, row_number() OVER (PARTITION BY corpus_id ORDER BY {by}) AS position FROM {tail} WHERE {where}) WHERE position <= 20"


@query("l2_divergence", " UNION ALL ".join([_top("high_score_low_proxy", "s = 'high' AND p = 'low'", "score DESC, sent_id"), _top("low_score_high_proxy", "s = 'low' AND p = 'high'", "score, sent_id"), _top("lowest", "pos <= 20", "pos"), _top("mid_range", "abs(pos - 1 - total // 2) <= 40", "abs(score - mid), sent_id", "placed JOIN mids USING (corpus_id)")]), **_DIV)
def _(v):
    d = selection.divergence(_proxied(v), "score", "proxy_index", "sent_id", BY)
    return d.select("corpus_id", "bucket", "sent_id", F.col("position").cast("long").alias("position"))


@query("l3_spot_check", "SELECT corpus_id, CASE WHEN pos <= 5 THEN 'low' ELSE 'high' END AS bucket, sent_id FROM ranked WHERE pos <= 5 OR pos > total - 5 UNION ALL SELECT corpus_id, 'average', sent_id FROM (SELECT r.corpus_id, r.sent_id, row_number() OVER (PARTITION BY r.corpus_id ORDER BY abs(r.score - m.score), r.sent_id) AS k FROM ranked r JOIN ranked m ON r.corpus_id = m.corpus_id AND m.pos - 1 = m.total // 2 WHERE r.pos > 5 AND r.pos <= r.total - 5) WHERE k <= 10", uniq="SELECT * FROM (SELECT corpus_id, sent_id, score, row_number() OVER (PARTITION BY corpus_id, sent_text ORDER BY score, sent_id) AS first FROM scores) WHERE first = 1", ranked="SELECT corpus_id, sent_id, score, row_number() OVER (PARTITION BY corpus_id ORDER BY score, sent_id) AS pos, count(*) OVER (PARTITION BY corpus_id) AS total FROM uniq")
def _(v):
    return selection.spot_check(v.scores().select("corpus_id", "sent_id", "score", "sent_text"), "score", "sent_id", "sent_text", BY).select("corpus_id", "bucket", "sent_id")


@query("l4_template", f"SELECT corpus_id, pool, sent_id, ['add_specific', 'de_specify', 'irrelevant_rewrite'][CAST((k - 1) % 3 AS INTEGER) + 1] AS edit_type FROM (SELECT corpus_id, pool, sent_id, row_number() OVER (PARTITION BY corpus_id, pool ORDER BY sha256(concat_ws(':', '11', sent_id)), sent_id) AS k FROM (SELECT corpus_id, sent_id, CASE WHEN e <> 'mid' THEN e WHEN abs(pos - 1 - total // 2) * 2 <= greatest(1, total // 10) THEN 'median' END AS pool FROM (SELECT corpus_id, sent_id, {_edge('score', 10)} AS e, row_number() OVER (PARTITION BY corpus_id ORDER BY score, sent_id) AS pos, count(*) OVER (PARTITION BY corpus_id) AS total FROM scores)) WHERE pool IS NOT NULL) WHERE k <= 10")
def _(v):
    t = selection.edit_template(v.scores().select("corpus_id", "sent_id", "score"), "score", "sent_id", BY, 10, "11", P.EDIT_TYPES)
    return t.select("corpus_id", "pool", "sent_id", "edit_type")


_FEATS = {"feats": "SELECT corpus_id, sent_id, " + ", ".join(f"{sql_q6(x)} AS {k}" for k, x in DENSE.items()) + ", CAST(len(t) AS DOUBLE) AS token_count, CAST(length(sent_text) AS DOUBLE) AS char_count FROM tokens"} | TOKENS
_NAMES = [*DENSE, "token_count", "char_count"]
_LONG = {
    "longf": "SELECT corpus_id, sent_id, unnest([" + ", ".join(map(lit, _NAMES)) + "]) AS feature, unnest([" + ", ".join(_NAMES) + "]) AS x FROM feats",
    "ranked": f"SELECT l.corpus_id, feature, x, {_AVG.format(by='l.corpus_id, feature', x='x')} AS rx, {_AVG.format(by='l.corpus_id, feature', x='score')} AS ry FROM longf l JOIN scores s ON l.sent_id = s.sent_id",
    "rhos": "SELECT corpus_id, feature, count(*) AS n, avg(x) AS mean, avg(CAST(x <> 0 AS INTEGER)) AS nonzero, CASE WHEN stddev_pop(rx) * stddev_pop(ry) = 0 THEN 0 ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho FROM ranked GROUP BY 1, 2",
} | _FEATS


def _feature_rhos(v):
    d = features.densities(v.scores()).select("corpus_id", "score", *(q6(F.col(k)).alias(k) for k in DENSE), F.col("token_count").cast("double").alias("token_count"), F.col("char_count").cast("double").alias("char_count"))
    # The score has one rank in its corpus, whatever the feature; a feature has few different values, whose rows are summed before these are ranked.
    # Ranks less their mean are exact, and so are their sums as far as doubles go.
    ranked = order.average_rank(written(d, "features"), "score", BY, "ry", total="n").withColumn("ry", F.col("ry") - (F.col("n") + 1) / 2)
    by, y = ["corpus_id", "feature"], F.col("ry")
    long = ranked.select("corpus_id", "ry", *_NAMES).unpivot(["corpus_id", "ry"], _NAMES, "feature", "x")
    sums = written(long.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")), "sums")
    j = sums.join(order.cumulative(sums, "x", by, times="c"), [*by, "x"])
    c, n, x = F.col("c"), F.max("cum_total"), F.col("cum_before") + (F.col("c") + 1) / 2 - (F.col("cum_total") + 1) / 2
    rho = F.try_divide(F.sum(x * F.col("y")), F.sqrt(F.sum(c * x * x)) * F.sqrt(F.sum("yy")))
    return j.groupBy(*by).agg(n.alias("n"), (F.sum(F.col("x") * c) / n).alias("mean"), (F.sum(F.when(F.col("x") != 0, c).otherwise(0)) / n).alias("nonzero"), F.coalesce(rho, F.lit(0.0)).alias("rho"))


@query("e21_proxy_corr", f"SELECT corpus_id, feature, n, {sql_q6('mean')} AS mean, {sql_q6('nonzero')} AS nonzero, {sql_q6('rho')} AS rho FROM rhos", **_LONG)
def _(v):
    return rounded(_feature_rhos(v))


@query("l7_top_features", f"SELECT corpus_id, feature, {sql_q6('rho')} AS rho, position FROM (SELECT corpus_id, feature, rho, row_number() OVER (PARTITION BY corpus_id ORDER BY abs({sql_q6('rho')}) DESC, feature) AS position FROM rhos) WHERE position <= 3", **_LONG)
def _(v):
    d = rounded(_feature_rhos(v)).select("corpus_id", "feature", "rho")
    return selection.top(d, 3, [F.desc(F.abs("rho")), F.col("feature")], BY).select("corpus_id", "feature", "rho", F.col("position").cast("long").alias("position"))


# --- estimators ----------------------------------------------------------------------------------

_SPEAR = {"sr": f"SELECT corpus_id, {_rank('percent')} AS a, {_rank('score')} AS b FROM scores"}
_RHO = "CASE WHEN stddev_pop(a) * stddev_pop(b) = 0 THEN {empty} ELSE covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END"


@query("e1_spearman", f"SELECT corpus_id, count(*) AS n, {sql_q6(_RHO.format(empty='0'))} AS rho FROM sr GROUP BY 1", **_SPEAR)
def _(v):
    return rounded(estimate.spearman(v.scores().select("corpus_id", "percent", "score"), "percent", "score", BY))


def _boot(by: str, key: str, source: str, seed: str = "7") -> dict:
    """SQL views ``units`` and ``weights`` of the resampled keys of a source."""
    return {
        "units": f"SELECT {by}, {key}, row_number() OVER (PARTITION BY {by} ORDER BY sha256(CAST({key} AS VARCHAR)), {key}) - 1 AS j, count(*) OVER (PARTITION BY {by}) AS total FROM (SELECT DISTINCT {by}, {key} FROM {source})",
        "picks": f"SELECT rep, {by}, CAST(floor(CAST(('0x' || substr(sha256(concat_ws(':', {lit(seed)}, rep // 8, {by}, j)), 8 * (rep % 8) + 1, 8)) AS BIGINT) / 4294967296.0 * total) AS BIGINT) AS j, count(*) AS w FROM (SELECT *, unnest(range(0, {REPS})) AS rep FROM units) GROUP BY 1, 2, 3",
        "weights": f"SELECT rep, p.{by}, {key}, w FROM picks p JOIN units u ON p.{by} = u.{by} AND p.j = u.j",
    }


_CI = "SELECT {by}, count(x) AS valid, " + sql_q6("quantile_cont(x, 0.025)") + " AS low, " + sql_q6("quantile_cont(x, 0.975)") + " AS high FROM reps GROUP BY 1"
_DOCS = _boot("corpus_id", "doc_path", "scores")
_MEANS = {"docsum": "SELECT corpus_id, doc_path, sum(score) AS s, count(*) AS c FROM scores GROUP BY 1, 2", "reps": "SELECT rep, w.corpus_id, sum(w * s) / sum(w * c) AS x FROM weights w JOIN docsum d ON w.corpus_id = d.corpus_id AND w.doc_path = d.doc_path GROUP BY 1, 2"} | _DOCS


def _ci(replicates, value: str, by: list[str]):
    return rounded(estimate.interval(replicates, value, by))


@query("e2_cluster_mean_ci", _CI.format(by="corpus_id"), **_MEANS)
def _(v):
    return _ci(estimate.cluster_means(v.scores(), "score", "doc_path", BY, REPS), "mean", BY)


@query("e2_cluster_median_ci", _CI.format(by="corpus_id"), **({"vals": "SELECT corpus_id, doc_path, percent AS v, count(*) AS c FROM scores GROUP BY 1, 2, 3", "wv": "SELECT rep, w.corpus_id, v, sum(w * c) AS k FROM weights w JOIN vals d ON w.corpus_id = d.corpus_id AND w.doc_path = d.doc_path GROUP BY 1, 2, 3", "cum": "SELECT rep, corpus_id, v, sum(k) OVER (PARTITION BY rep, corpus_id ORDER BY v) AS upto, k, sum(k) OVER (PARTITION BY rep, corpus_id) AS total FROM wv", "reps": "SELECT rep, corpus_id, (max(v) FILTER ((total - 1) // 2 + 1 > upto - k AND (total - 1) // 2 + 1 <= upto) + max(v) FILTER (total // 2 + 1 > upto - k AND total // 2 + 1 <= upto)) / 2 AS x FROM cum GROUP BY 1, 2"} | _DOCS))
def _(v):
    return _ci(estimate.cluster_medians(v.scores().select("corpus_id", "doc_path", "percent"), "percent", "doc_path", BY, REPS), "median", BY)


_CASES = _boot("edit_type", "case_id", "candidates")


@query("e3_unit_ci", _CI.format(by="edit_type"), **({"casesum": "SELECT edit_type, case_id, sum(delta) AS s, count(*) AS c FROM candidates WHERE metric = 'a' GROUP BY 1, 2", "reps": "SELECT rep, w.edit_type, sum(w * s) / sum(w * c) AS x FROM weights w JOIN casesum d ON w.case_id = d.case_id AND w.edit_type = d.edit_type GROUP BY 1, 2"} | _CASES))
def _(v):
    c = v.candidates().where("metric = 'a'")
    return _ci(estimate.cluster_means(c, "delta", "case_id", ["edit_type"], REPS), "mean", ["edit_type"])


@query("e4_proportion_ci", _CI.format(by="corpus_id"), **(_MEANS | {"docsum": "SELECT corpus_id, doc_path, sum(CAST(score >= 0.5 AS DOUBLE)) AS s, count(*) AS c FROM scores GROUP BY 1, 2"}))
def _(v):
    s = v.scores().withColumn("hit", (F.col("score") >= 0.5).cast("double"))
    return _ci(estimate.cluster_means(s, "hit", "doc_path", BY, REPS), "mean", BY)


@query("e5_rank_corr_ci", _CI.format(by="corpus_id"), **({"rk": f"SELECT corpus_id, doc_path, CAST({_rank('percent')} AS DOUBLE) AS a, CAST({_rank('score')} AS DOUBLE) AS b FROM scores", "docsum": "SELECT corpus_id, doc_path, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM rk GROUP BY 1, 2", "tot": "SELECT rep, w.corpus_id, sum(w * n) AS n, sum(w * sa) AS sa, sum(w * sb) AS sb, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM weights w JOIN docsum d ON w.corpus_id = d.corpus_id AND w.doc_path = d.doc_path GROUP BY 1, 2", "reps": "SELECT rep, corpus_id, (n * ab - sa * sb) / nullif(sqrt(greatest(0, n * aa - sa * sa)) * sqrt(greatest(0, n * bb - sb * sb)), 0) AS x FROM tot"} | _DOCS))
def _(v):
    return _ci(estimate.cluster_rank_correlations(v.scores().select("corpus_id", "doc_path", "percent", "score"), "percent", "score", "doc_path", BY, REPS), "rho", BY)


_JOINT = {
    "small": f"SELECT corpus_id, sent_id, label_mean AS x, {sql_uniform('sent_id')} AS y FROM wide WHERE label_mean IS NOT NULL",
    "copies": "SELECT rep, w.corpus_id, x, y, unnest(range(0, w.w)) AS copy FROM weights w JOIN small s ON w.corpus_id = s.corpus_id AND w.sent_id = s.sent_id",
    "rr": f"SELECT rep, corpus_id, {_AVG.format(by='rep, corpus_id', x='x')} AS a, {_AVG.format(by='rep, corpus_id', x='y')} AS b FROM copies",
    "reps": f"SELECT rep, corpus_id, {_RHO.format(empty='NULL')} AS x FROM rr GROUP BY 1, 2",
} | _WIDE | _boot("corpus_id", "sent_id", "small")


@query("e6_joint_corr_ci", _CI.format(by="corpus_id"), **_JOINT)
def _(v):
    s = _wide(v).where("label_mean is not null").select("corpus_id", "sent_id", F.col("label_mean").alias("x"), X.uniform(F.col("sent_id")).alias("y"))
    return _ci(estimate.joint_correlations(s, "x", "y", "sent_id", BY, REPS), "rho", BY)


@query("e7_stratified_ci", f"SELECT count(x) AS valid, {sql_q6('quantile_cont(x, 0.025)')} AS low, {sql_q6('quantile_cont(x, 0.975)')} AS high FROM reps", **({"casesum": "SELECT edit_type, case_id, sum(delta) AS s, count(*) AS c FROM candidates GROUP BY 1, 2", "reps": "SELECT rep, sum(w * s) / sum(w * c) AS x FROM weights w JOIN casesum d ON w.case_id = d.case_id AND w.edit_type = d.edit_type GROUP BY 1"} | _CASES))
def _(v):
    c = v.candidates()
    sums = c.groupBy("edit_type", "case_id").agg(F.sum("delta").alias("s"), F.count("delta").alias("c"))
    reps = estimate.draws(sums, "case_id", ["edit_type"], REPS).join(sums, ["edit_type", "case_id"]).groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("mean"))
    return rounded(estimate.interval(reps, "mean", []))


@query("e8_interval", f"SELECT corpus_id, count(x) AS valid, CASE WHEN count(x) >= 0.95 * count(*) THEN {sql_q6('quantile_cont(x, 0.025)')} END AS low, CASE WHEN count(x) >= 0.95 * count(*) THEN {sql_q6('quantile_cont(x, 0.975)')} END AS high FROM (SELECT corpus_id, CASE WHEN rep % 10 = 0 AND corpus_id = 'en' THEN NULL ELSE x END AS x FROM reps) GROUP BY 1", **_MEANS)
def _(v):
    reps = estimate.cluster_means(v.scores(), "score", "doc_path", BY, REPS).withColumn("mean", F.when(~((F.col("rep") % 10 == 0) & (F.col("corpus_id") == "en")), F.col("mean")))
    return rounded(estimate.interval(reps, "mean", BY, 0.95))


_SUP = {
    "cells": "SELECT corpus_id, n AS len, count(*) AS rows, count(DISTINCT doc_path) AS documents, sum(score) AS s FROM lengths GROUP BY 1, 2",
    "good": "SELECT len FROM cells WHERE rows >= 30 AND documents >= 20 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT corpus_id) FROM lengths)",
    "shares": "SELECT c.*, rows / CAST(sum(rows) OVER (PARTITION BY corpus_id) AS DOUBLE) AS share FROM cells c JOIN good USING (len)",
    "refs": "SELECT len, raw / sum(raw) OVER () AS reference FROM (SELECT len, avg(share) AS raw FROM shares GROUP BY 1)",
    "support": "SELECT s.*, reference, reference / share AS weight FROM shares s JOIN refs USING (len)",
} | SIZED


def _length_rows(v):
    return v.scores().select("corpus_id", "doc_path", "score", X.token_count(F.col("sent_text")).alias("len"))


def _support(v):
    return estimate.common_support(_length_rows(v), "len", least_rows=30, least_docs=20)


@query("e9_support", f"SELECT corpus_id, len, rows AS n, documents, {sql_q6('share')} AS share, {sql_q6('reference')} AS reference, {sql_q6('weight')} AS weight FROM support", **_SUP)
def _(v):
    return rounded(_support(v))


@query("e10_standardised", f"SELECT corpus_id, CAST(sum(rows) AS BIGINT) AS n, {sql_q6('sum(s) / sum(rows)')} AS mean, {sql_q6('sum(weight * s) / sum(weight * rows)')} AS standardised_mean, {sql_q6('power(sum(weight * rows), 2) / sum(weight * weight * rows)')} AS ess FROM support GROUP BY 1", **_SUP)
def _(v):
    return rounded(estimate.standardised(_length_rows(v), "score", "len", _support(v)))


_STDBOOT = {
    "held": "SELECT l.corpus_id, doc_path, n AS len, score, reference FROM lengths l JOIN support s ON l.corpus_id = s.corpus_id AND l.n = s.len",
    "docsum": "SELECT corpus_id, doc_path, len, reference, sum(score) AS s, count(*) AS c FROM held GROUP BY 1, 2, 3, 4",
    "strata": "SELECT rep, w.corpus_id, len, reference, sum(w * s) / sum(w * c) AS m FROM weights w JOIN docsum d ON w.corpus_id = d.corpus_id AND w.doc_path = d.doc_path GROUP BY 1, 2, 3, 4",
    "reps": "SELECT rep, corpus_id, CASE WHEN count(*) = (SELECT count(*) FROM good) THEN sum(reference * m) END AS x FROM strata GROUP BY 1, 2",
} | _SUP | _boot("corpus_id", "doc_path", "held")


@query("e11_standardised_ci", _CI.format(by="corpus_id"), **_STDBOOT)
def _(v):
    return _ci(estimate.standardised_replicates(_length_rows(v), "score", "len", _support(v), "doc_path", REPS), "mean", BY)


_KNOTS = [1.0, 1.6, 2.1, 2.6, 3.2]


def _basis_sql(x: str) -> list[str]:
    a, last, before = _KNOTS[0], _KNOTS[-1], _KNOTS[-2]
    cube = lambda k: f"power(greatest({x} - {k}, 0), 3)"
    return [x] + [f"({cube(k)} - {cube(before)} * ({last - k} / {last - before}) + {cube(last)} * ({before - k} / {last - before})) / {(last - a) ** 2}" for k in _KNOTS[:-2]]


@query("e12_spline", "SELECT len, " + ", ".join(f"{sql_q6(b)} AS b{i}" for i, b in enumerate(_basis_sql("ln(CAST(len AS DOUBLE))"))) + " FROM (SELECT DISTINCT n AS len FROM lengths WHERE n > 0)", **SIZED)
def _(v):
    d = _length_rows(v).where("len > 0").select("len").distinct()
    return d.select("len", *(q6(b).alias(f"b{i}") for i, b in enumerate(estimate.spline_basis(F.ln("len"), _KNOTS))))


def _fit(v, interaction: bool = False):
    d = _length_rows(v).where("len > 0")
    basis = estimate.spline_basis(F.ln("len"), _KNOTS)
    terms = {"intercept": F.lit(1.0)} | {f"corpus_{c}": (F.col("corpus_id") == c).cast("double") for c in ("de", "es", "fr")} | {f"spline_{i}": b for i, b in enumerate(basis)}
    if interaction:
        terms |= {f"corpus_{c}:spline_{i}": (F.col("corpus_id") == c).cast("double") * b for c in ("de", "es", "fr") for i, b in enumerate(basis)}
    return estimate.cluster_ols(d, "score", terms, "doc_path")


@query("e13_ols")
def _(v):
    fit = _fit(v)
    rows = [(n, float(b), float(s), int(fit["n"]), int(fit["clusters"])) for n, b, s in zip(fit["names"], fit["beta"], fit["se"], strict=True)]
    return rounded(v.spark.createDataFrame(rows, "term string, estimate double, se double, n long, clusters long"))


@query("e14_contrasts")
def _(v):
    fit = _fit(v)
    rows = [(c, *estimate.contrast(fit, {f"corpus_{c}": 1.0})) for c in ("de", "es", "fr")]
    return rounded(v.spark.createDataFrame(rows, "corpus_id string, gap double, se double, low double, high double"))


@query("e15_interaction")
def _(v):
    import math

    fit = _fit(v, interaction=True)
    rows = []
    for c in ("de", "es", "fr"):
        gaps = []
        for n in (4, 7, 10, 14, 20):
            x = math.log(n)
            k, a = _KNOTS, (_KNOTS[-1] - _KNOTS[0]) ** 2
            cube = lambda t: max(x - t, 0.0) ** 3  # noqa: B023, E731
            terms = [x] + [(cube(t) - cube(k[-2]) * (k[-1] - t) / (k[-1] - k[-2]) + cube(k[-1]) * (k[-2] - t) / (k[-1] - k[-2])) / a for t in k[:-2]]
            gaps.append(estimate.contrast(fit, {f"corpus_{c}": 1.0} | {f"corpus_{c}:spline_{i}": t for i, t in enumerate(terms)})[0])
        rows.append((c, max(gaps) - min(gaps), estimate.heterogeneous(gaps)))
    return rounded(v.spark.createDataFrame(rows, "corpus_id string, gap_range double, heterogeneous boolean"))


_KAPPA = {
    "kc": "SELECT a, b, count(*) AS n FROM wide WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2",
    "ks": "SELECT label, row_number() OVER (ORDER BY label) AS i FROM (SELECT a AS label FROM kc UNION SELECT b FROM kc)",
    "ma": "SELECT a, sum(n) AS n FROM kc GROUP BY 1", "mb": "SELECT b, sum(n) AS n FROM kc GROUP BY 1", "kn": "SELECT sum(n) AS n FROM kc", "kk": "SELECT greatest(count(*) - 1, 1) AS k FROM ks",
    "seen": "SELECT sum(CAST(a <> b AS INTEGER) * c.n) / CAST(any_value(t.n) AS DOUBLE) AS u, sum(abs(x.i - y.i) / CAST(k AS DOUBLE) * c.n) / any_value(t.n) AS l, sum(power(abs(x.i - y.i) / CAST(k AS DOUBLE), 2) * c.n) / any_value(t.n) AS q, sum(CAST(a = b AS INTEGER) * c.n) * 100.0 / any_value(t.n) AS same, any_value(t.n) AS n FROM kc c JOIN ks x ON x.label = a JOIN ks y ON y.label = b, kn t, kk",
    "chance": "SELECT sum(CAST(a <> b AS INTEGER) * ma.n * mb.n) / CAST(any_value(t.n * t.n) AS DOUBLE) AS u, sum(abs(x.i - y.i) / CAST(k AS DOUBLE) * ma.n * mb.n) / any_value(t.n * t.n) AS l, sum(power(abs(x.i - y.i) / CAST(k AS DOUBLE), 2) * ma.n * mb.n) / any_value(t.n * t.n) AS q FROM ma JOIN ks x ON x.label = a, mb JOIN ks y ON y.label = b, kn t, kk",
} | _WIDE


@query("e16_kappa", f"SELECT CAST(s.n AS BIGINT) AS n, {sql_q6('s.same')} AS agreement, {sql_q6('1 - s.u / c.u')} AS kappa, {sql_q6('1 - s.l / c.l')} AS kappa_linear, {sql_q6('1 - s.q / c.q')} AS kappa_quadratic FROM seen s, chance c", **_KAPPA)
def _(v):
    return rounded(agreement.kappa(_wide(v), "a", "b", []))


@query("e17_agreement", f"SELECT corpus_id, {sql_q6('avg(CAST(a = b AS INTEGER)) * 100')} AS percent FROM wide WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1", **_WIDE)
def _(v):
    return _wide(v).where("a is not null and b is not null").groupBy("corpus_id").agg(q6(F.avg((F.col("a") == F.col("b")).cast("int")) * 100).alias("percent"))


@query("e18_binned_gap", f"SELECT corpus_id, CAST(sum(n) AS BIGINT) AS rows, count(*) AS bins, {sql_q6('sum(n * abs(s - l)) / sum(n)')} AS gap FROM (SELECT corpus_id, bin, count(*) AS n, avg(y) AS s, avg(l) AS l FROM (SELECT d.corpus_id, y, l, len(list_filter(e, lambda x: x < y)) AS bin FROM bg d JOIN be USING (corpus_id)) GROUP BY 1, 2) GROUP BY 1", **({"bg": f"SELECT corpus_id, {sql_uniform('sent_id')} AS y, (label_mean - 1) / 4 AS l FROM wide WHERE label_mean IS NOT NULL", "be": "SELECT corpus_id, list_filter(list_distinct(quantile_cont(y, [0.2, 0.4, 0.6, 0.8, 1.0])), lambda x: x > min(y)) AS e FROM bg GROUP BY 1"} | _WIDE))
def _(v):
    s = _wide(v).select("corpus_id", "label_mean", X.uniform(F.col("sent_id")).alias("y"))
    return rounded(agreement.binned_gap(s, "y", "label_mean", 5, BY))


@query("e19_paired_contrast", f"SELECT corpus_id, count(x) AS valid, {sql_q6('quantile_cont(x, 0.025)')} AS low, {sql_q6('quantile_cont(x, 0.975)')} AS high FROM (SELECT a.corpus_id AS corpus_id, a.x - b.x AS x FROM reps a JOIN reps b ON a.rep = b.rep AND b.corpus_id = 'en' AND a.corpus_id <> 'en') GROUP BY 1", **_MEANS)
def _(v):
    reps = estimate.cluster_means(v.scores(), "score", "doc_path", BY, REPS)
    return _ci(estimate.contrasts(reps, "mean", "corpus_id", "en", []), "difference", BY)


@query("e20_invariance", f"SELECT corpus_id, {sql_q6(_RHO.format(empty='0'))} AS rho, true AS invariant FROM sr GROUP BY 1", **_SPEAR)
def _(v):
    s = v.scores().select("corpus_id", "percent", "score")
    g = s.groupBy("corpus_id").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d"))
    # Sums of doubles follow the order of their parts, so z is made once: ranks meet its rows by equality. Constant scores have no spread, and stay constant.
    s = written(s.join(F.broadcast(g), "corpus_id").select("corpus_id", "percent", "score", F.coalesce(F.try_divide(F.col("score") - F.col("m"), F.col("d")), F.lit(0.0)).alias("z")), "normalised")
    a, b = estimate.spearman(s, "percent", "score", BY), estimate.spearman(s, "percent", "z", BY).withColumnRenamed("rho", "rho_z")
    return a.join(b.select("corpus_id", "rho_z"), "corpus_id").select("corpus_id", q6(F.col("rho")).alias("rho"), (F.abs(F.col("rho") - F.col("rho_z")) <= 1e-9).alias("invariant"))


@query("e22_span_ratio", f"SELECT a.corpus_id AS corpus_id, {sql_q6('a.s - b.s')} AS difference, {sql_q6('a.s / b.s')} AS ratio, CASE WHEN {sql_q6('a.s / b.s')} <= 0.8 THEN 'narrower' WHEN {sql_q6('a.s / b.s')} >= 1.25 THEN 'broader' ELSE 'similar' END AS band FROM sp a, sp b WHERE b.corpus_id = 'en' AND a.corpus_id <> 'en'", sp=f"SELECT corpus_id, {_q(0.95, 'percent')} - {_q(0.05, 'percent')} AS s FROM scores GROUP BY 1")
def _(v):
    q = order.quantiles(v.scores().select("corpus_id", "percent"), "percent", BY, {"a": 0.05, "b": 0.95}).select("corpus_id", (F.col("b") - F.col("a")).alias("s"))
    ref = q.where("corpus_id = 'en'").select(F.col("s").alias("r"))
    d = q.where("corpus_id <> 'en'").join(F.broadcast(ref)).select("corpus_id", q6(F.col("s") - F.col("r")).alias("difference"), q6(F.try_divide("s", "r")).alias("ratio"))
    return d.withColumn("band", ladders.span_band(F.col("ratio")))


@query("e23_determinism", f"SELECT corpus_id, {sql_q6('avg(abs(score - score2))')} AS mean_difference, {sql_q6('max(abs(score - score2))')} AS most_difference, max(abs(score - score2)) <= 0.5 AS within FROM scores GROUP BY 1")
def _(v):
    d = F.abs(F.col("score") - F.col("score2"))
    return v.scores().groupBy("corpus_id").agg(q6(F.avg(d)).alias("mean_difference"), q6(F.max(d)).alias("most_difference"), (F.max(d) <= 0.5).alias("within"))


@query("e24_kendall", f"SELECT edit_type, {sql_q6('sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy)))')} AS tau FROM (SELECT a.edit_type, sign(a.u - b.u) AS dx, sign(a.d - b.d) AS dy FROM kt a JOIN kt b ON a.edit_type = b.edit_type AND a.case_id < b.case_id) GROUP BY 1", **({"kt": "SELECT edit_type, case_id, max(utility) AS u, max(delta) AS d FROM judged GROUP BY 1, 2 HAVING max(utility) IS NOT NULL"} | _OUT))
def _(v):
    s = _judged(v).groupBy("edit_type", "case_id").agg(F.max("utility").alias("u"), F.max("delta").alias("d")).where("u is not null")
    return rounded(estimate.kendall_tau(s, "u", "d", "case_id", ["edit_type"]))


@query("e25_reproduction", f"SELECT corpus_id, CASE WHEN abs(d) <= 2 * 0.002 THEN 'match' WHEN abs(d) > 4 * 0.002 THEN 'shift' ELSE 'indeterminate' END AS class FROM (SELECT corpus_id, {sql_q6('avg(score) - 0.5')} AS d FROM scores GROUP BY 1)")
def _(v):
    d = v.scores().groupBy("corpus_id").agg(q6(F.avg("score") - 0.5).alias("d"))
    return d.select("corpus_id", ladders.reproduction(F.col("d"), F.lit(0.002)).alias("class"))


@query("e26_utility", "SELECT case_id, slot, d AS delta, utility, valid FROM judged", **_OUT)
def _(v):
    return _judged(v).select("case_id", "slot", F.col("d").alias("delta"), "utility", "valid")


_LONGM = {"models": "SELECT corpus_id, sent_id, n AS len, unnest(['run1', 'run2']) AS model_id, unnest([score, score2]) AS value FROM lengths"} | _SUP


@query("e27_models_standardised", f"SELECT model_id, m.corpus_id AS corpus_id, {sql_q6('sum(weight * value) / sum(weight)')} AS standardised_mean FROM models m JOIN support s ON m.corpus_id = s.corpus_id AND m.len = s.len GROUP BY 1, 2", **_LONGM)
def _(v):
    s = v.scores().select("corpus_id", X.token_count(F.col("sent_text")).alias("len"), F.col("score").alias("run1"), F.col("score2").alias("run2")).unpivot(["corpus_id", "len"], ["run1", "run2"], "model_id", "value")
    sums = s.groupBy("model_id", "corpus_id", "len").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    j = sums.join(_support(v).select("corpus_id", "len", "weight"), ["corpus_id", "len"])
    return j.groupBy("model_id", "corpus_id").agg(q6(F.sum(F.col("weight") * F.col("s")) / F.sum(F.col("weight") * F.col("c"))).alias("standardised_mean"))


@query("e28_model_summary", f"SELECT model_id, corpus_id, count(*) AS n, {sql_q6('avg(value)')} AS mean, {sql_q6('stddev_pop(value)')} AS std, rank() OVER (PARTITION BY model_id ORDER BY {sql_q6('avg(value)')} DESC) AS place FROM (SELECT corpus_id, unnest(['run1', 'run2', 'run3']) AS model_id, unnest([score, score2, score3]) AS value FROM scores) GROUP BY 1, 2")
def _(v):
    s = v.scores().select("corpus_id", F.col("score").alias("run1"), F.col("score2").alias("run2"), F.col("score3").alias("run3")).unpivot("corpus_id", ["run1", "run2", "run3"], "model_id", "value")
    g = rounded(s.groupBy("model_id", "corpus_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))
    return g.withColumn("place", F.rank().over(Window.partitionBy("model_id").orderBy(F.desc("mean"))).cast("long"))


_JUDGES = {"jl": "SELECT sent_id, unnest(['a', 'b', 'c']) AS judge, unnest([a, b, c]) AS label FROM wide WHERE present = 3", "jr": "SELECT x.judge AS j1, y.judge AS j2, x.label AS la, y.label AS lb FROM jl x JOIN jl y ON x.sent_id = y.sent_id AND x.judge < y.judge", "jk": f"SELECT j1, j2, la, lb, {_AVG.format(by='j1, j2', x='la')} AS a, {_AVG.format(by='j1, j2', x='lb')} AS b FROM jr"} | _WIDE


@query("e29_judge_agreement", f"SELECT j1, j2, count(*) AS n, {sql_q6('avg(abs(la - lb))')} AS distance, {sql_q6(_RHO.format(empty='NULL'))} AS rho FROM jk GROUP BY 1, 2", **_JUDGES)
def _(v):
    w = _wide(v).where("present = 3")
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("j1"), F.lit(y).alias("j2"), F.col(x).alias("la"), F.col(y).alias("lb")) for x, y in (("a", "b"), ("a", "c"), ("b", "c")))))
    d = w.select(pairs.alias("p")).select("p.*")
    ranked = order.average_ranks(d, {"la": "ra", "lb": "rb"}, ["j1", "j2"])
    return rounded(ranked.groupBy("j1", "j2").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("la") - F.col("lb"))).alias("distance"), correlation(F.col("ra"), F.col("rb")).alias("rho")))


@query("e30_generator_contrast", f"SELECT edit_type, count(x) AS valid, {sql_q6('quantile_cont(x, 0.025)')} AS low, {sql_q6('quantile_cont(x, 0.975)')} AS high FROM (SELECT a.edit_type AS edit_type, a.x - b.x AS x FROM reps a JOIN reps b ON a.rep = b.rep AND a.edit_type = b.edit_type AND a.metric = 'b' AND b.metric = 'a') GROUP BY 1", **({"casesum": "SELECT edit_type, metric, case_id, sum(CAST(delta > 0 AS DOUBLE)) AS s, count(*) AS c FROM candidates GROUP BY 1, 2, 3", "reps": "SELECT rep, w.edit_type, metric, sum(w * s) / sum(w * c) AS x FROM weights w JOIN casesum d ON w.case_id = d.case_id AND w.edit_type = d.edit_type GROUP BY 1, 2, 3"} | _CASES))
def _(v):
    by = ["edit_type", "metric"]
    sums = v.candidates().groupBy(*by, "case_id").agg(F.sum((F.col("delta") > 0).cast("double")).alias("s"), F.count(F.lit(1)).alias("c"))
    reps = estimate.draws(sums.select("edit_type", "case_id").distinct(), "case_id", ["edit_type"], REPS).join(sums, ["edit_type", "case_id"]).groupBy("rep", *by).agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("rate"))
    return _ci(estimate.contrasts(reps.where("metric <> 'c'"), "rate", "metric", "a", ["edit_type"]), "difference", ["edit_type"])


@query("e31_direction", "SELECT edit_type, count(*) FILTER (CASE edit_type WHEN 'add_specific' THEN delta > 0 WHEN 'de_specify' THEN delta < 0 END) AS consistent, count(*) FILTER (CASE edit_type WHEN 'add_specific' THEN -delta > 0 WHEN 'de_specify' THEN -delta < 0 END) AS coarse FROM candidates GROUP BY 1")
def _(v):
    k, d = F.col("edit_type"), F.col("delta")
    hit = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return v.candidates().groupBy("edit_type").agg(hit(agreement.consistent_direction(d, k)).alias("consistent"), hit(agreement.consistent_direction(d, k, True)).alias("coarse"))


# --- ladders -------------------------------------------------------------------------------------

_GAPS = {"gm": f"SELECT corpus_id, {sql_q6('avg(score)')} AS raw, {sql_q6('avg(score) FILTER (keep)')} AS kept FROM strict GROUP BY 1", "gaps": f"SELECT a.corpus_id AS corpus_id, {sql_q6('a.raw - b.raw')} AS raw, {sql_q6('a.kept - b.kept')} AS kept FROM gm a, gm b WHERE b.corpus_id = 'en' AND a.corpus_id <> 'en'"}


def _gaps(v):
    g = v.strict().groupBy("corpus_id").agg(q6(F.avg("score")).alias("raw"), q6(F.avg(F.when(F.col("keep"), F.col("score")))).alias("kept"))
    ref = g.where("corpus_id = 'en'").select(F.col("raw").alias("r"), F.col("kept").alias("k"))
    return g.where("corpus_id <> 'en'").join(F.broadcast(ref)).select("corpus_id", q6(F.col("raw") - F.col("r")).alias("raw"), q6(F.col("kept") - F.col("k")).alias("kept"))


@query("c1_gap_interpretation", "SELECT corpus_id, CASE WHEN raw * kept < 0 THEN 'reversal' WHEN kept - 0.001 <= 0 AND kept + 0.001 >= 0 THEN 'ambiguity' WHEN abs(kept) < abs(raw) THEN 'attenuation' ELSE 'survival' END AS label FROM gaps", **_GAPS)
def _(v):
    k = F.col("kept")
    return _gaps(v).select("corpus_id", ladders.gap_interpretation(F.col("raw"), k, k - 0.001, k + 0.001).alias("label"))


@query("c2_gap_category", "SELECT corpus_id, CASE WHEN raw * kept < 0 AND (kept - 0.001 > 0 OR kept + 0.001 < 0) THEN 'reversed' WHEN NOT (kept - 0.001 > 0 OR kept + 0.001 < 0) OR abs(kept) < 0.02 THEN 'eliminated' WHEN abs(kept) < 0.8 * abs(raw) THEN 'attenuated' ELSE 'persistent' END AS label FROM gaps", **_GAPS)
def _(v):
    k = F.col("kept")
    return _gaps(v).select("corpus_id", ladders.gap_category(F.col("raw"), k, k - 0.001, k + 0.001, F.lit(False)).alias("label"))


@query("c3_bands", "SELECT corpus_id, CASE WHEN raw <= -0.05 THEN 'less' WHEN raw >= 0.05 THEN 'more' ELSE 'similar' END AS share_band FROM gaps", **_GAPS)
def _(v):
    return _gaps(v).select("corpus_id", ladders.share_band(F.col("raw")).alias("share_band"))


_SHAPE = f"SELECT corpus_id, {sql_q6('any_value(m) / CAST(count(*) AS DOUBLE)')} AS mode_share, {sql_q6('greatest(count(*) FILTER (percent <= 5), count(*) FILTER (percent >= 95)) / CAST(count(*) AS DOUBLE)')} AS edge_share, {sql_q6('(' + _q(0.95, 'percent') + ' - ' + _q(0.05, 'percent') + ') / 100')} AS dynamic FROM scores JOIN (SELECT corpus_id, max(n) AS m FROM (SELECT corpus_id, percent, count(*) AS n FROM scores GROUP BY 1, 2) GROUP BY 1) USING (corpus_id) GROUP BY 1"


@query("c4_shape", "SELECT corpus_id, CASE WHEN mode_share >= 0.1 THEN 'mass_point' WHEN edge_share >= 0.2 THEN 'boundary' WHEN dynamic >= 0.7 THEN 'broad' WHEN dynamic < 0.4 THEN 'narrow' ELSE 'moderate' END AS shape FROM shp", shp=_SHAPE)
def _(v):
    s = v.scores().select("corpus_id", "percent")
    d = summary.distribution(s, "percent", ("corpus_id",), 0.0, 100.0)
    b = summary.boundaries(s, "percent", ("corpus_id",), 0.0, 100.0, (0.05,))
    j = d.join(b.select("corpus_id", F.greatest("low_share", "high_share").alias("edge")), "corpus_id")
    return j.select("corpus_id", ladders.shape(q6(F.col("mode_share")), q6(F.col("edge")), F.lit(0.0), q6(F.col("effective_dynamic_range"))).alias("shape"))


@query("c5_consistency", "SELECT corpus_id, CASE WHEN count(DISTINCT band) = 1 THEN 'consistent' ELSE 'heterogeneous' END AS label FROM (SELECT corpus_id, run, CASE WHEN m <= 0.49 THEN 'less' WHEN m >= 0.51 THEN 'more' ELSE 'similar' END AS band FROM (SELECT corpus_id, run, avg(x) AS m FROM (SELECT corpus_id, unnest([1, 2, 3]) AS run, unnest([score, score2, score3]) AS x FROM scores) GROUP BY 1, 2)) GROUP BY 1")
def _(v):
    m = v.scores().groupBy("corpus_id").agg(F.avg("score").alias("a"), F.avg("score2").alias("b"), F.avg("score3").alias("c")).unpivot("corpus_id", ["a", "b", "c"], "run", "m")
    band = F.when(F.col("m") <= 0.49, "less").when(F.col("m") >= 0.51, "more").otherwise("similar")
    return m.groupBy("corpus_id").agg(F.countDistinct(band).alias("k")).select("corpus_id", ladders.consistency(F.col("k")).alias("label"))




@query("u7_embedding_correlation", f"SELECT i, j, count(*) AS n, {sql_q6('covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))')} AS r FROM (SELECT a.i AS i, b.i AS j, CAST(a.x AS DOUBLE) AS x, CAST(b.x AS DOUBLE) AS y FROM em a JOIN em b ON a.vec_id = b.vec_id AND a.i < b.i) GROUP BY 1, 2", em="SELECT vec_id, unnest(range(0, 8)) AS i, unnest(embedding[1:8]) AS x FROM embeddings")
def _(v):
    pairs = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col("embedding")[i].cast("double").alias("x"), F.col("embedding")[j].cast("double").alias("y")) for i in range(8) for j in range(i + 1, 8))))
    d = v.table("embeddings").select(pairs.alias("p")).select("p.*")
    return d.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), q6(correlation(F.col("x"), F.col("y"))).alias("r"))


@query("e2_cluster_mean_scale", _CI.format(by="l_returnflag"), **({"docsum": "SELECT l_returnflag, l_orderkey, sum(l_discount) AS s, count(*) AS c FROM lineitem GROUP BY 1, 2", "reps": "SELECT rep, w.l_returnflag, sum(w * s) / sum(w * c) AS x FROM weights w JOIN docsum d ON w.l_returnflag = d.l_returnflag AND w.l_orderkey = d.l_orderkey GROUP BY 1, 2"} | _boot("l_returnflag", "l_orderkey", "lineitem")))
def _(v):
    return _ci(estimate.cluster_means(v.table("lineitem"), "l_discount", "l_orderkey", ["l_returnflag"], REPS), "mean", ["l_returnflag"])


@query("features_table", "SELECT t.corpus_id AS corpus_id, t.sent_id AS sent_id, " + sql_q6("coalesce(a, 0)") + " AS tfidf_mean_nonzero, " + sql_q6("coalesce(m, 0)") + " AS tfidf_max, " + ", ".join(f"{sql_q6(x)} AS {k}" for k, x in DENSE.items()) + " FROM tokens t LEFT JOIN weights w ON t.corpus_id = w.corpus_id AND t.sent_id = w.sent_id", **_TF)
def _(v):
    f = features.feature_table(v.sentences())
    return rounded(f.select("corpus_id", "sent_id", "tfidf_mean_nonzero", "tfidf_max", *DENSE))
