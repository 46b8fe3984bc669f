"""Registered queries on contracts: scorer inputs, frozen cases, maps, returned packets, logs, dispositions, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.numeric import q6
from ..operators import checks, contracts
from ..operators.order import row_number
from ..sources import readers, sinks
from .views import sql, sql_q6, sql_strip

ALL: dict = {}


def query(name: str, text: str, **views: str):
    def add(make):
        ALL[name] = (make, sql(text, **views))
        return make

    return add


_REPLAY = "SELECT corpus_id, no_unit, count(*) AS n, " + sql_q6("{x}") + " AS mean FROM scores GROUP BY 1, 2"
_SENT = f"SELECT *, CASE WHEN {sql_strip('sent_text')} = '' THEN 'blank_text' WHEN regexp_matches(sent_text, '[\\r\\n]') THEN 'newline' WHEN count(*) OVER (PARTITION BY short_id) > 1 THEN 'duplicate' END AS problem FROM (SELECT substr(sent_id, 1, 4) AS short_id, corpus_id, sent_text FROM sentences)"


@query("s16_scorer_input", "SELECT corpus_id, problem, count(*) AS n FROM checked GROUP BY 1, 2", checked=_SENT)
def _(v):
    """With ids cut to four digits, so that some are duplicates."""
    s = v.sentences().select(F.substring("sent_id", 1, 4).alias("sent_id"), "corpus_id", F.col("sent_text").alias("text"))
    return contracts.scorer_input(s).groupBy("corpus_id", "problem").agg(F.count(F.lit(1)).alias("n"))


_FROZEN = "SELECT corpus_id, sent_id, row_number() OVER (PARTITION BY corpus_id ORDER BY sha256(sent_id), sent_id) - 1 AS i FROM sentences WHERE NOT regexp_matches(sent_text, '[\\r\\n]')"


@query(
    "s17_canonical_freeze",
    "SELECT f.corpus_id, f.n, f.digest, b.invalid FROM (SELECT corpus_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM (SELECT corpus_id, i // 64 AS b, count(*) AS n, sha256(string_agg(sent_id, chr(10) ORDER BY i)) AS h FROM frozen GROUP BY 1, 2) GROUP BY 1) f"
    " JOIN (SELECT corpus_id, count(*) FILTER (regexp_matches(sent_text, '[\\r\\n]')) AS invalid FROM sentences GROUP BY 1) b ON f.corpus_id = b.corpus_id",
    frozen=_FROZEN,
)
def _(v):
    s = v.sentences().select("corpus_id", "sent_id", contracts.input_problem("sent_id", "sent_text").alias("problem"))
    valid = row_number(s.where("problem is null").select("corpus_id", "sent_id"), ["sent_id"], ["corpus_id"], "i", key=F.col("sent_id"))
    invalid = s.groupBy("corpus_id").agg(F.count_if(F.col("problem").isNotNull()).alias("invalid"))
    return checks.ordered_digest(valid, "sent_id", ["i"], ["corpus_id"], block=64).join(invalid, "corpus_id")


@query("s18_edit_cases", "SELECT sha256(concat_ws(chr(0), CAST(case_id AS VARCHAR), CAST(slot AS VARCHAR), edit_type)) AS pair_id, edit_type FROM pairs")
def _(v):
    return contracts.edit_cases(v.pairs(), P.EDIT_TYPES).select("pair_id", "edit_type")


@query("s19_edit_template", f"SELECT edit_type, count(*) AS n, count(*) FILTER ({sql_strip('edited')} <> '') AS complete FROM (SELECT edit_type, CASE WHEN case_id % 5 = 2 THEN ' ' ELSE edited END AS edited FROM pairs) GROUP BY 1")
def _(v):
    p = v.pairs().withColumn("edited", F.when(F.col("case_id") % 5 == 2, " ").otherwise(F.col("edited")))
    return contracts.edit_cases(p, P.EDIT_TYPES).groupBy("edit_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("complete").alias("complete"))


@query("s20_score_maps", f"SELECT model_id, count(*) AS n, count(*) FILTER (again > 1) AS repeated, {sql_q6('avg(score)')} AS mean FROM (SELECT model_id, score, count(*) OVER (PARTITION BY model_id, k) AS again FROM (SELECT 'full' AS model_id, sent_id AS k, score FROM scores UNION ALL SELECT 'short', substr(sent_id, 1, 4), score2 FROM scores)) GROUP BY 1")
def _(v):
    s = v.scores()
    maps = {"full": s.select(F.col("sent_id").alias("k"), "score"), "short": s.select(F.substring("sent_id", 1, 4).alias("k"), F.col("score2").alias("score"))}
    return contracts.score_map(maps, "k", "score").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("repeated").alias("repeated"), q6(F.avg("score")).alias("mean"))


@query("s21_accepted_edits", "SELECT case_id, slot FROM pairs WHERE case_id % 7 = 3")
def _(v):
    """Every seventh case's text is changed after its digest was taken."""
    p = v.pairs().withColumn("digest", F.sha2("edited", 256)).withColumn("edited", F.when(F.col("case_id") % 7 == 3, F.concat("edited", F.lit("."))).otherwise(F.col("edited")))
    return contracts.rehash(p, "edited", "digest").select("case_id", "slot")


@query("k1_feature_sink", "SELECT sent_id, printf('%.8f', floor(score * 1e8) / 1e8) AS score FROM scores")
def _(v):
    path = sinks.scratch(v.spark, "features-csv")
    sinks.csv(sinks.formatted(v.scores().select("sent_id", (F.floor(F.col("score") * 1e8) / 1e8).alias("score")), "%.8f"), path)
    return readers.csv(v.spark, path, "sent_id string, score string")


@query("k4_append_log", "SELECT case_id, attempt, status FROM attempts")
def _(v):
    """Two appends to one log of JSON lines, then the whole log."""
    path = sinks.scratch(v.spark, "append-log")
    a = v.attempts().select("case_id", "attempt", "status")
    for odd in (True, False):
        a.where((F.col("attempt") % 2 == 1) == odd).write.mode("append").json(path)
    return readers.jsonl(v.spark, path, "case_id long, attempt long, status string", key=("case_id", "attempt"))


@query("k12_score_publication", f"SELECT coalesce(corpus_id, 'all') AS corpus_id, count(*) AS n, {sql_q6('avg(score)')} AS mean, {sql_q6('stddev_pop(score)')} AS std FROM scores GROUP BY GROUPING SETS ((corpus_id), ())")
def _(v):
    g = v.scores().select("corpus_id", "score").rollup("corpus_id").agg(F.count(F.lit(1)).alias("n"), q6(F.avg("score")).alias("mean"), q6(F.stddev_pop("score")).alias("std"))
    return g.withColumn("corpus_id", F.coalesce("corpus_id", F.lit("all")))


@query("k16_portable_paths", "SELECT page_id, CASE WHEN starts_with(p, '/srv/run/') THEN substr(p, 10) ELSE list_last(string_split(p, '/')) END AS path FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/home/x/' ELSE '/srv/run/' END || 'out/' || CAST(page_id AS VARCHAR) || '.csv' AS p FROM pages)")
def _(v):
    at = F.concat(F.when(F.col("page_id") % 3 == 0, "/home/x/").otherwise("/srv/run/"), F.lit("out/"), F.col("page_id").cast("string"), F.lit(".csv"))
    return v.table("pages").select("page_id", contracts.portable(at, ("/srv/run",)).alias("path"))


@query("u8_replicates", f"SELECT corpus_id, r AS replicate, CAST(('0x' || substr(sha256(concat_ws(':', 'boot', corpus_id, CAST(r AS VARCHAR))), 1, 8)) AS BIGINT) & 2147483647 AS seed FROM (SELECT DISTINCT corpus_id FROM docs) g, (SELECT unnest(range(0, 200)) AS r)")
def _(v):
    return contracts.replicates(v.docs(), ["corpus_id"], 200, "boot")


_RETURNED = """SELECT o_orderkey AS k, sha256(CASE WHEN o_orderkey % 37 = 4 THEN 'x' ELSE o_orderstatus END) AS d FROM orders WHERE o_orderkey % 31 <> 3
    UNION ALL SELECT o_orderkey, sha256(o_orderstatus) FROM orders WHERE o_orderkey % 41 = 5 UNION ALL SELECT -o_orderkey, sha256(o_orderstatus) FROM orders WHERE o_orderkey % 101 = 7"""


@query(
    "v12_return_audit",
    "SELECT k, problem FROM (SELECT coalesce(s.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'missing' WHEN s.k IS NULL THEN 'unknown' WHEN r.n > 1 THEN 'repeated' WHEN s.d <> r.low OR s.d <> r.high THEN 'changed' END AS problem"
    " FROM (SELECT o_orderkey AS k, sha256(o_orderstatus) AS d FROM orders) s FULL JOIN (SELECT k, count(*) AS n, min(d) AS low, max(d) AS high FROM returned GROUP BY k) r ON s.k = r.k) WHERE problem IS NOT NULL",
    returned=_RETURNED,
)
def _(v):
    """A packet of which some rows are lost, changed, sent twice or made up."""
    o = v.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("t"))
    source = o.select("k", F.sha2("t", 256).alias("d"))
    back = o.where("k % 31 <> 3").select("k", F.sha2(F.when(F.col("k") % 37 == 4, "x").otherwise(F.col("t")), 256).alias("d"))
    back = back.union(source.where("k % 41 = 5")).union(source.where("k % 101 = 7").select((-F.col("k")).alias("k"), "d"))
    return contracts.return_audit(source, back, "k", "d")


@query("v9_replay", f"SELECT corpus_id, no_unit, n, mean, (SELECT count(*) FROM (SELECT DISTINCT corpus_id, no_unit FROM scores)) AS rows, (SELECT count(*) = 0 FROM (SELECT * FROM one EXCEPT SELECT * FROM two)) AS same FROM two", one=_REPLAY.format(x="avg(score)"), two=_REPLAY.format(x="sum(CAST(score AS DECIMAL(18, 14))) / CAST(count(*) AS DOUBLE)"))
def _(v):
    """The same analysis over differently dealt rows: what the second run gives, and whether the first gave just that."""
    run = lambda s: s.groupBy("corpus_id", "no_unit").agg(F.count(F.lit(1)).alias("n"), q6(F.avg("score")).alias("mean"))
    again = run(v.scores().repartition(7, "sent_id"))
    return again.crossJoin(contracts.replayed(run(v.scores()), again))


@query("v10_recomputation", f"SELECT corpus_id, unnest(['mean', 'variance']) AS column_name, unnest([{sql_q6('avg(score)')}, {sql_q6('var_pop(score)')}]) AS a, unnest([{sql_q6('avg(score)')}, {sql_q6('avg(score * score) - avg(score) * avg(score)')}]) AS b, unnest([true, abs(var_pop(score) - (avg(score * score) - avg(score) * avg(score))) <= 5e-9]) AS within FROM scores GROUP BY 1")
def _(v):
    """Means and variances by the engine's aggregates, and again from decimal sums."""
    s, d = v.scores(), F.col("score").cast("decimal(18,14)")
    one = s.groupBy("corpus_id").agg(F.avg("score").alias("mean"), F.var_pop("score").alias("variance"))
    mean = F.sum(d).cast("double") / F.count(F.lit(1))
    square = F.sum((F.col("score") * F.col("score")).cast("decimal(18,14)")).cast("double") / F.count(F.lit(1))
    both = contracts.recomputed(one, s.groupBy("corpus_id").agg(mean.alias("mean"), (square - mean * mean).alias("variance")), ["corpus_id"], ["mean", "variance"])
    return both.select("corpus_id", "column_name", q6(F.col("a")).alias("a"), q6(F.col("b")).alias("b"), "within")


@query("v14_completed_runs", "SELECT case_id, count(*) AS rows, bool_or(status = 'purchase') AS ended, bool_or(status = 'purchase') AND max(attempt) = count(*) AND count(DISTINCT attempt) = count(*) AS complete FROM attempts WHERE event_id % 53 <> 9 GROUP BY 1")
def _(v):
    log = v.attempts().where("event_id % 53 <> 9")
    return contracts.completed(log, "case_id", "attempt", F.col("status"), ("purchase",))


@query("g2_tamper_check", "SELECT case_id, attempt FROM attempts WHERE event_id % 89 = 5")
def _(v):
    """A chained log of attempts, of which some states were changed afterwards."""
    log = contracts.chain_log(v.attempts().select("case_id", "attempt", "event_id", "status"), ["case_id"], "attempt", "status")
    log = log.withColumn("status", F.when(F.col("event_id") % 89 == 5, F.concat("status", F.lit("!"))).otherwise(F.col("status")))
    return contracts.tampered(log, ["case_id"], "attempt", "status").select("case_id", "attempt")


@query("g3_lockstep", "SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.sent_id IS NULL THEN 'right' WHEN b.sent_id IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT sent_id FROM scores WHERE NOT starts_with(sent_id, '0')) a FULL JOIN (SELECT sent_id FROM scores WHERE NOT starts_with(sent_id, 'f')) b ON a.sent_id = b.sent_id) GROUP BY 1")
def _(v):
    s = v.sentences().select("sent_id")
    j = contracts.lockstep(s.where(~F.col("sent_id").startswith("0")), s.where(~F.col("sent_id").startswith("f")), "sent_id")
    return j.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


_STATE = "list_filter([CASE WHEN length(edited) < 40 THEN 'short' END, CASE WHEN edited = original THEN 'same' END, CASE WHEN contains(edited, '@') THEN 'private' END], lambda x: x IS NOT NULL)"


@query("c6_dispositions", f"SELECT edit_type, disposition, count(*) AS n FROM (SELECT edit_type, CASE WHEN case_id % 11 = 4 OR len(list_filter(failed, lambda x: x NOT IN ('short', 'same'))) > 0 THEN 'withheld' WHEN len(failed) > 0 THEN 'waived' ELSE 'accepted' END AS disposition FROM (SELECT *, {_STATE} AS failed FROM pairs)) GROUP BY 1, 2")
def _(v):
    """Short and unchanged edits may be waived, private ones may not; every eleventh case is bound to another source."""
    tests = F.array(F.when(F.length("edited") < 40, "short"), F.when(F.col("edited") == F.col("original"), "same"), F.when(F.col("edited").contains("@"), "private"))
    got = contracts.disposition(F.col("case_id") % 11 != 4, F.filter(tests, lambda x: x.isNotNull()), F.array(F.lit("short"), F.lit("same")))
    return v.pairs().select("edit_type", got.alias("disposition")).groupBy("edit_type", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query("d3_scalars", f"SELECT l_orderkey, l_linenumber, {sql_q6('ln(1 + l_quantity)')} AS log_quantity, {sql_q6('sqrt(abs(l_discount - 0.05))')} AS root, least(greatest(CAST(l_quantity AS DOUBLE), 5), 40) AS clipped, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS low, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS high FROM lineitem")
def _(v):
    d = lambda c: F.col(c).cast("double")
    clipped = F.least(F.greatest(d("l_quantity"), F.lit(5.0)), F.lit(40.0)).alias("clipped")
    return v.table("lineitem").select("l_orderkey", "l_linenumber", q6(F.log(1 + d("l_quantity"))).alias("log_quantity"), q6(F.sqrt(F.abs(d("l_discount") - 0.05))).alias("root"), clipped, F.floor(d("l_extendedprice") / 1000).alias("low"), F.ceil(d("l_extendedprice") / 1000).alias("high"))
