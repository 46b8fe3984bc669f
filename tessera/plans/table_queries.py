"""Registered queries on sources, joins, sets, logs, expectations and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import q6
from ..functions.text import uniform
from ..operators import checks, selection
from ..sources import readers, sinks
from .views import lit, sql, sql_q6, sql_uniform

ALL: dict = {}


def query(name: str, text: str | None = None, **views: str):
    def add(make):
        ALL[name] = (make, sql(text, **views) if text else None)
        return make

    return add


# --- sources and sinks: written in the format, read back with its reader ---------------------------


@query("s7_csv_roundtrip", "SELECT corpus_id, doc_path, sent_idx, sent_text, sent_id FROM sentences")
def _(v):
    path = sinks.scratch(v.spark, "sentences-csv")
    sinks.csv(v.sentences(), path)
    return readers.csv(v.spark, path, readers.SENTENCES)


@query("s8_scores_tsv_roundtrip", f"SELECT sent_id, {sql_q6('score')} AS score FROM scores")
def _(v):
    path = sinks.scratch(v.spark, "scores-tsv")
    v.scores().select("sent_id", q6(F.col("score")).alias("score")).write.option("sep", "\t").csv(path)
    return readers.scores(v.spark, path)


@query("s9_sniffed_scores", f"SELECT sent_id, {sql_q6('score')} AS score FROM scores")
def _(v):
    path = sinks.scratch(v.spark, "scores-sniffed")
    s = v.scores().select("sent_id", F.lit("x").alias("note"), q6(F.col("score")).alias("score"))
    s.write.option("sep", "\t").option("header", True).csv(path)
    return readers.sniffed_scores(v.spark, path)


@query("s10_key_filtered", f"SELECT sent_id, {sql_q6('score')} AS score FROM scores WHERE sent_id LIKE 'a%'")
def _(v):
    s = v.scores().select("sent_id", q6(F.col("score")).alias("score"))
    return readers.keyed_scores(s, s.where(F.col("sent_id").startswith("a")))


@query("s11_attempt_log", "SELECT status, count(*) AS n, CAST(max(attempt) AS BIGINT) AS last FROM attempts GROUP BY 1")
def _(v):
    path = sinks.scratch(v.spark, "attempts-jsonl")
    v.attempts().select("case_id", "attempt", "status").write.json(path)
    log = readers.jsonl(v.spark, path, "case_id long, attempt long, status string", key=("case_id", "attempt"))
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("attempt").alias("last"))


@query("s14_predictions", f"SELECT count(*) AS n, {sql_q6('sum(floor(score * 1000) / 1000)')} AS total FROM scores")
def _(v):
    path = sinks.scratch(v.spark, "predictions")
    shown = F.format_string("%.3f", F.floor(F.col("score") * 1000) / 1000)
    v.scores().select(F.when(F.col("no_unit"), shown).otherwise(F.concat(F.lit("tensor("), shown, F.lit(")")))).write.text(path)
    return readers.predictions(v.spark, path).agg(F.count(F.lit(1)).alias("n"), q6(F.sum("value")).alias("total"))


@query("s2_globbed_scan", "SELECT corpus_id || '/' || doc_path || '.md' AS doc_path, sha256(content) AS digest FROM docs WHERE corpus_id IN ('de', 'fr') AND NOT starts_with(doc_path, '1')")
def _(v):
    root = sinks.scratch(v.spark, "files")
    sinks.files(v.docs().select(F.concat("corpus_id", F.lit("/"), "doc_path", F.lit(".md")).alias("doc_path"), "content"), root)
    got = readers.documents(v.spark, root, ["de/*.md", "**/fr/**", "de/*.md"], ["*/1*.md"])
    return got.select("doc_path", F.sha2("content", 256).alias("digest"))


@query("s15_annotated_names", "SELECT 'src' || (doc_id % 3) AS corpus, 'ann' || (doc_id % 2) AS annotator, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1, 2")
def _(v):
    k = F.col("doc_id")
    name = F.when(k % 5 == 0, "other.csv").otherwise(F.concat(F.lit("in/src"), (k % 3).cast("string"), F.lit("_spot_check_v1__ann"), (k % 2).cast("string"), F.lit(".csv")))
    corpus, annotator = readers.annotated_name(name)
    return v.table("documents").select(corpus.alias("corpus"), annotator.alias("annotator")).where("corpus is not null").groupBy("corpus", "annotator").agg(F.count(F.lit(1)).alias("n"))


@query("k2_formatted_sink", "SELECT sent_id, printf('%.9f', floor(score * 1e9) / 1e9) AS score, CASE WHEN no_unit THEN '1' ELSE '0' END AS no_unit FROM scores")
def _(v):
    s = v.scores().select("sent_id", (F.floor(F.col("score") * 1e9) / 1e9).alias("score"), "no_unit")
    return sinks.formatted(s, "%.9f")


@query("k13_qa_examples", "SELECT reason, corpus_id, sent_id, position FROM (SELECT reason, corpus_id, sent_id, row_number() OVER (PARTITION BY reason ORDER BY corpus_id, sent_id) AS position FROM (SELECT corpus_id, sent_id, unnest(reason_codes) AS reason FROM strict)) WHERE position <= 10")
def _(v):
    d = v.strict().select("corpus_id", "sent_id", F.explode("reason_codes").alias("reason"))
    return selection.top(d, 10, ["corpus_id", "sent_id"], ["reason"]).select("reason", "corpus_id", "sent_id", F.col("position").cast("long").alias("position"))


@query("k15_paper_pivot", f"SELECT corpus_id, {sql_q6('avg(score)')} AS run1, {sql_q6('avg(score2)')} AS run2, {sql_q6('avg(score3)')} AS run3 FROM scores GROUP BY 1")
def _(v):
    long = v.scores().select("corpus_id", F.col("score").alias("run1"), F.col("score2").alias("run2"), F.col("score3").alias("run3")).unpivot("corpus_id", ["run1", "run2", "run3"], "model_id", "value")
    wide = long.groupBy("corpus_id").pivot("model_id", ["run1", "run2", "run3"]).agg(F.avg("value"))
    return wide.select("corpus_id", *(q6(F.col(c)).alias(c) for c in ("run1", "run2", "run3")))


# --- joins ---------------------------------------------------------------------------------------


@query("j1_three_way", f"SELECT corpus_id, sent_id, {sql_q6('score')} AS score, CAST(length(sent_text) AS BIGINT) AS char_count FROM scores")
def _(v):
    s = v.scores()
    tables = {"sentences": s.select("sent_id", "corpus_id"), "scores": s.select("sent_id", q6(F.col("score")).alias("score")), "features": s.select("sent_id", F.length("sent_text").cast("long").alias("char_count"))}
    return checks.strict_join(tables, "sent_id").select("corpus_id", "sent_id", "score", "char_count")


@query("j2_set_equality", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'documents,labels' ELSE 'documents' END AS present FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(v):
    return checks.key_mismatch({"documents": v.table("documents"), "labels": v.table("labels")}, "doc_id")


@query("j3_lockstep", f"SELECT corpus_id, count(*) AS n, count(*) FILTER (abs(score - score2) < 0.1) AS near, {sql_q6('max(abs(score - score3))')} AS most FROM scores GROUP BY 1")
def _(v):
    s = v.scores()
    runs = [s.select("corpus_id", "sent_id", "doc_path", "sent_idx", F.col(c)) for c in ("score", "score2", "score3")]
    j = runs[0].join(runs[1], ["corpus_id", "sent_id", "doc_path", "sent_idx"]).join(runs[2], ["corpus_id", "sent_id", "doc_path", "sent_idx"])
    return j.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("score") - F.col("score2")) < 0.1).alias("near"), q6(F.max(F.abs(F.col("score") - F.col("score3")))).alias("most"))


@query("j4_lookup", "SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(v):
    return v.table("documents").select("doc_id", "source").join(v.table("labels").select("doc_id", "quality"), "doc_id")


@query("j5_suffix_compare", "SELECT b.annotator, count(*) AS n, count(*) FILTER (a.label IS DISTINCT FROM b.label) AS mismatches FROM annotators a JOIN annotators b ON a.sent_id = b.sent_id AND a.annotator = 'ann1' AND b.annotator <> 'ann1' GROUP BY 1")
def _(v):
    a = v.annotators()
    first = a.where("annotator = 'ann1'").select("sent_id", F.col("label").alias("canonical"))
    return a.where("annotator <> 'ann1'").join(first, "sent_id").groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label").eqNullSafe(F.col("canonical"))).alias("mismatches"))


@query("j6_annotator_pivot", "SELECT sent_id, max(label) FILTER (annotator = 'ann1') AS ann1, max(label) FILTER (annotator = 'ann2') AS ann2, max(label) FILTER (annotator = 'ann3') AS ann3 FROM annotators GROUP BY 1 HAVING count(label) = 3")
def _(v):
    names = ["ann1", "ann2", "ann3"]
    return v.annotators().groupBy("sent_id").pivot("annotator", names).agg(F.max("label")).where(" and ".join(f"{n} is not null" for n in names))


_KEY = "lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"


def _norm():
    return F.lower(F.regexp_replace("text", "[^A-Za-z]+", " "))


@query("j7_semi", f"SELECT doc_id FROM documents WHERE length({_KEY}) % 7 IN (SELECT length({_KEY}) % 7 FROM benchmark WHERE item_id < 3)")
def _(v):
    keys = v.table("benchmark").where("item_id < 3").select((F.length(_norm()) % 7).alias("k"))
    return v.table("documents").select("doc_id", (F.length(_norm()) % 7).alias("k")).join(keys, "k", "left_semi").select("doc_id")


@query("j8_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(v):
    return v.table("documents").select("doc_id").join(v.table("labels").select("doc_id"), "doc_id", "left_anti")


@query("j9_star", f"SELECT r_name, n_name, count(*) AS orders, {sql_q6('sum(o_totalprice)')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(v):
    o, c = v.table("orders").select("o_custkey", "o_totalprice"), v.table("customer").select("c_custkey", "c_nationkey")
    sums = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))  # before the join
    j = sums.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("orders").alias("orders"), F.sum("total").alias("total"))
    j = j.join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum("orders").alias("orders"), q6(F.sum("total")).alias("total"))


_LIMITS = "(VALUES ('en', 0.2, 0.8), ('de', 0.1, 0.9), ('fr', 0.0, 1.0), ('es', 0.3, 0.7))"


@query("j10_dimension", f"SELECT s.corpus_id, count(*) AS n, count(*) FILTER (score BETWEEN lo AND hi) AS inside FROM scores s JOIN {_LIMITS} AS c(corpus_id, lo, hi) ON s.corpus_id = c.corpus_id GROUP BY 1")
def _(v):
    c = v.spark.createDataFrame([("en", 0.2, 0.8), ("de", 0.1, 0.9), ("fr", 0.0, 1.0), ("es", 0.3, 0.7)], "corpus_id string, lo double, hi double")
    return v.scores().join(F.broadcast(c), "corpus_id").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").between(F.col("lo"), F.col("hi"))).alias("inside"))


@query("j11_pair", f"SELECT case_id, slot, edit_type, {sql_q6(sql_uniform('edited') + ' - ' + sql_uniform('original'))} AS delta FROM pairs")
def _(v):
    p = v.pairs()
    long = p.select("case_id", "slot", "edit_type", F.explode(F.array(F.struct(F.lit("o").alias("v"), uniform(F.col("original")).alias("s")), F.struct(F.lit("e").alias("v"), uniform(F.col("edited")).alias("s")))).alias("x"))
    g = long.groupBy("case_id", "slot", "edit_type").agg(F.max(F.when(F.col("x.v") == "e", F.col("x.s"))).alias("e"), F.max(F.when(F.col("x.v") == "o", F.col("x.s"))).alias("o"))
    checks.require(g.where("e is null or o is null"), "incomplete pairs")
    return g.select("case_id", "slot", "edit_type", q6(F.col("e") - F.col("o")).alias("delta"))


BEST = {"best": "SELECT case_id, metric, slot FROM (SELECT case_id, metric, slot, row_number() OVER (PARTITION BY case_id, metric ORDER BY CASE edit_type WHEN 'add_specific' THEN -delta WHEN 'de_specify' THEN delta ELSE abs(delta) END, slot) AS r FROM candidates) WHERE r = 1"}


@query("j12_policy_self", "SELECT a.metric AS metric, count(*) AS cases, count(*) FILTER (a.slot = b.slot) AS same FROM best a JOIN best b ON a.case_id = b.case_id AND b.metric = 'a' AND a.metric <> 'a' GROUP BY 1", **BEST)
def _(v):
    best = selection.best_of_n(v.candidates(), by=("metric",))
    ref = best.where("metric = 'a'").select("case_id", F.col("slot").alias("ref"))
    return best.where("metric <> 'a'").join(ref, "case_id").groupBy("metric").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("slot") == F.col("ref")).alias("same"))


@query("j13_two_arm", f"SELECT a.case_id AS case_id, {sql_q6('avg(a.delta) - avg(b.delta)')} AS difference FROM candidates a JOIN candidates b ON a.case_id = b.case_id AND a.slot = b.slot AND a.metric = 'a' AND b.metric = 'b' GROUP BY 1")
def _(v):
    c = v.candidates()
    a, b = (c.where(F.col("metric") == m).select("case_id", "slot", F.col("delta").alias(m)) for m in ("a", "b"))
    return a.join(b, ["case_id", "slot"]).groupBy("case_id").agg(q6(F.avg("a") - F.avg("b")).alias("difference"))


@query("j14_within_case", f"SELECT a.case_id AS case_id, count(*) AS pairs, {sql_q6('min(abs(a.delta - b.delta))')} AS nearest FROM candidates a JOIN candidates b ON a.case_id = b.case_id AND a.slot < b.slot AND a.metric = 'a' AND b.metric = 'a' GROUP BY 1")
def _(v):
    c = v.candidates().where("metric = 'a'")
    a, b = c.select("case_id", F.col("slot").alias("i"), F.col("delta").alias("x")), c.select("case_id", F.col("slot").alias("j"), F.col("delta").alias("y"))
    return a.join(b, "case_id").where("i < j").groupBy("case_id").agg(F.count(F.lit(1)).alias("pairs"), q6(F.min(F.abs(F.col("x") - F.col("y")))).alias("nearest"))


@query("j15_recomputed_hash", "SELECT corpus_id, count(*) AS rows, count(*) FILTER (sha256(concat_ws(chr(10), corpus_id, doc_path, CAST(sent_idx AS VARCHAR), sent_text)) = sent_id) AS bound FROM sentences GROUP BY 1")
def _(v):
    from ..functions.text import sentence_id

    s = v.sentences()
    back = s.select(sentence_id(F.col("corpus_id"), F.col("doc_path"), F.col("sent_idx"), F.col("sent_text")).alias("sent_id"), F.lit(1).alias("hit"))
    return s.select("corpus_id", "sent_id").join(back, "sent_id", "left").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("bound"))


MEANS = {"means": "SELECT corpus_id, avg(score) AS m FROM scores GROUP BY 1"}


@query("j16_vs_reference", f"SELECT a.corpus_id AS corpus_id, {sql_q6('a.m - b.m')} AS gap FROM means a, means b WHERE b.corpus_id = 'en' AND a.corpus_id <> 'en'", **MEANS)
def _(v):
    m = v.scores().groupBy("corpus_id").agg(F.avg("score").alias("m"))
    ref = m.where("corpus_id = 'en'").select(F.col("m").alias("ref"))  # one row
    return m.where("corpus_id <> 'en'").join(F.broadcast(ref)).select("corpus_id", q6(F.col("m") - F.col("ref")).alias("gap"))


# --- sets ----------------------------------------------------------------------------------------


@query("o1_union", "SELECT kind, count(*) AS n FROM (SELECT 'document' AS kind FROM documents UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'item' FROM benchmark) GROUP BY 1")
def _(v):
    d = v.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    p, b = v.table("pages").select(F.lit("page").alias("kind")), v.table("benchmark").select(F.lit("item").alias("kind"))
    return d.unionByName(p, allowMissingColumns=True).unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("o2_intersect", "SELECT sent_text FROM sentences WHERE corpus_id = 'en' INTERSECT SELECT sent_text FROM sentences WHERE corpus_id = 'de'")
def _(v):
    s = v.sentences()
    return s.where("corpus_id = 'en'").select("sent_text").intersect(s.where("corpus_id = 'de'").select("sent_text"))


@query("o3_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(v):
    return v.table("documents").select("doc_id").exceptAll(v.table("labels").select("doc_id"))


@query("o4_equal", "SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS equal, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_right FROM documents")
def _(v):
    d, lab = v.table("documents").select("doc_id"), v.table("labels").select("doc_id")
    m = checks.key_mismatch({"left": d, "right": lab}, "doc_id").agg(F.count_if(F.col("present") == "left").alias("only_left"), F.count_if(F.col("present") == "right").alias("only_right"))
    return m.select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"), "only_left", "only_right")


@query("o5_distinct", "SELECT corpus_id, count(DISTINCT sent_text) AS texts, count(DISTINCT doc_path) AS documents FROM sentences GROUP BY 1")
def _(v):
    return v.sentences().groupBy("corpus_id").agg(F.countDistinct("sent_text").alias("texts"), F.countDistinct("doc_path").alias("documents"))


@query("o6_overlap", "SELECT (SELECT count(*) FROM (SELECT lower(sent_text) FROM sentences WHERE sent_idx % 2 = 0 INTERSECT SELECT lower(sent_text) FROM sentences WHERE sent_idx % 2 = 1)) AS normalised, (SELECT count(*) FROM (SELECT sent_text FROM sentences WHERE sent_idx % 2 = 0 INTERSECT SELECT sent_text FROM sentences WHERE sent_idx % 2 = 1)) AS exact")
def _(v):
    s = v.sentences().select("sent_text", (F.col("sent_idx") % 2).alias("arm"))

    def shared(text, name):
        return s.select(text.alias("t"), "arm").groupBy("t").agg(F.min("arm").alias("a"), F.max("arm").alias("b")).agg(F.count_if(F.col("a") < F.col("b")).alias(name))

    return shared(F.lower("sent_text"), "normalised").join(F.broadcast(shared(F.col("sent_text"), "exact")))


# --- logs and order ------------------------------------------------------------------------------


@query("w12_contiguity", "SELECT case_id, count(*) AS rows, min(attempt) AS first, max(attempt) AS last, count(DISTINCT attempt) AS distinct_n FROM (SELECT case_id, attempt FROM attempts WHERE event_id % 50 <> 0) GROUP BY 1 HAVING min(attempt) <> 1 OR max(attempt) <> count(*) OR count(DISTINCT attempt) <> count(*)")
def _(v):
    return checks.not_contiguous(v.attempts().where("event_id % 50 <> 0"), "case_id", "attempt")


@query("w13_first_accept", "SELECT case_id, min(attempt) AS attempt, arg_min(event_id, attempt) AS event_id FROM attempts WHERE status = 'purchase' GROUP BY 1")
def _(v):
    return v.attempts().where("status = 'purchase'").groupBy("case_id").agg(F.min("attempt").alias("attempt"), F.min_by("event_id", "attempt").alias("event_id"))


@query("w14_hash_chain", "SELECT case_id, attempt FROM (SELECT case_id, attempt, lag(h) OVER (PARTITION BY case_id ORDER BY attempt) AS before, CASE WHEN attempt = 1 THEN NULL WHEN event_id % 97 = 0 THEN 'x' ELSE lag(h) OVER (PARTITION BY case_id ORDER BY attempt) END AS prev FROM (SELECT case_id, attempt, event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM attempts)) WHERE before IS DISTINCT FROM prev")
def _(v):
    w = Window.partitionBy("case_id").orderBy("attempt")
    log = v.attempts().withColumn("h", F.sha2(F.col("event_id").cast("string"), 256))
    log = log.withColumn("prev", F.when(F.col("attempt") == 1, None).when(F.col("event_id") % 97 == 0, "x").otherwise(F.lag("h").over(w)))
    return checks.broken_chain(log, "attempt", "h", "prev", ["case_id"]).select("case_id", "attempt")


_HALVES = "row_number() OVER (PARTITION BY edit_type ORDER BY sha256(concat_ws(':', 'sides', CAST(case_id AS VARCHAR))), case_id) <= count(*) OVER (PARTITION BY edit_type) // 2"


@query("w15_sides", f"SELECT case_id, edit_type, CASE WHEN {_HALVES} THEN 'A' ELSE 'B' END AS side FROM (SELECT DISTINCT case_id, edit_type FROM candidates)")
def _(v):
    return selection.half_split(v.candidates().select("case_id", "edit_type").distinct(), "case_id", ["edit_type"], "sides", ("A", "B"), "side").select("case_id", "edit_type", "side")


@query("w16_packet_order", "SELECT case_id, slot, row_number() OVER (ORDER BY sha256('packet:' || concat_ws('-', case_id, slot))) AS position FROM reviews")
def _(v):
    r = v.reviews().select("case_id", "slot", F.concat_ws("-", "case_id", "slot").alias("k"))
    return selection.packet_order(r, "k", "packet").select("case_id", "slot", F.col("position").cast("long").alias("position"))


@query("p22_hash_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256('seed:' || CAST(doc_id AS VARCHAR))) AS position FROM documents")
def _(v):
    return selection.packet_order(v.table("documents").select("doc_id"), "doc_id", "seed").select("doc_id", F.col("position").cast("long").alias("position"))


@query("l1_total_order", "SELECT corpus_id, min(sent_id) AS first, max(sent_id) AS last FROM sentences GROUP BY 1")
def _(v):
    return v.sentences().groupBy("corpus_id").agg(F.min("sent_id").alias("first"), F.max("sent_id").alias("last"))


@query("l5_dedupe", "SELECT arg_min(sent_id, sent_id) AS sent_id, sent_text FROM sentences GROUP BY sent_text")
def _(v):
    return selection.keep_first(v.sentences().select("sent_id", "sent_text"), "sent_text", ["sent_id"]).select("sent_id", "sent_text")


@query("l6_first_n", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 25")
def _(v):
    return v.table("pages").select("page_id", "url").orderBy("page_id").limit(25)


# --- JSON, time, reasons -------------------------------------------------------------------------


@query("m1_payload", "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props) AND len(json_keys(props)) >= 1) AS objects FROM events GROUP BY 1")
def _(v):
    keys = F.json_object_keys("props")
    return v.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.size(keys) >= 1, F.lit(False))).alias("objects"))


@query("m4_canonical_json", "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}') AS digest FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "n_chars")), 256).alias("digest"))


@query("m5_reasons", "SELECT array_to_string(reason_codes, ';') AS reason_codes, count(*) AS n FROM strict GROUP BY 1")
def _(v):
    joined = F.array_join("reason_codes", ";")
    back = F.array_join(F.filter(F.split(joined, ";"), lambda r: r != ""), ";")
    return v.strict().groupBy(back.alias("reason_codes")).agg(F.count(F.lit(1)).alias("n"))


@query("m6_multiset_equal", "SELECT edit_type, count(*) AS n, count(*) FILTER (list_sort(list_filter(string_split(lower(original), ' '), lambda w: w IN ('the', 'of'))) = list_sort(list_filter(string_split(lower(edited), ' '), lambda w: w IN ('the', 'of')))) AS equal FROM pairs GROUP BY 1")
def _(v):
    side = lambda c: F.array_sort(F.filter(F.split(F.lower(c), " "), lambda w: w.isin("the", "of")))
    return v.pairs().groupBy("edit_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(side("original") == side("edited")).alias("equal"))


@query("m7_template", "SELECT case_id, slot, 'Rewrite in at most ' || CAST(ceil(len(list_filter(regexp_split_to_array(original, '[ \t\n\r\f]+'), lambda w: w <> '')) * 1.5) AS BIGINT) || ' words (' || edit_type || ').' AS prompt FROM pairs")
def _(v):
    from ..functions.text import token_count

    limit = F.ceil(token_count(F.col("original")) * F.lit(1.5)).cast("string")
    return v.pairs().select("case_id", "slot", F.concat(F.lit("Rewrite in at most "), limit, F.lit(" words ("), "edit_type", F.lit(").")).alias("prompt"))


@query("d1_ms_arithmetic", "SELECT case_id, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS span_ms, max(epoch_us(ts) // 1000) + 1500 AS due_ms FROM attempts GROUP BY 1")
def _(v):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return v.attempts().groupBy("case_id").agg((F.max(ms) - F.min(ms)).alias("span_ms"), (F.max(ms) + 1500).alias("due_ms"))


@query("d2_rounding_gate", "SELECT corpus_id, floor(avg(score) * 10 + 0.5) = 5 AS mean_ok, floor(stddev_pop(score) * 10 + 0.5) = 3 AS std_ok, floor(avg(score) * 10 + 0.5) = 5 AND floor(stddev_pop(score) * 10 + 0.5) = 3 AS ok FROM scores GROUP BY 1")
def _(v):
    s = v.scores().groupBy("corpus_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    base = v.spark.createDataFrame([(c, 0.5, 0.3) for c in ("en", "de", "fr", "es")], "corpus_id string, mean double, std double")
    return checks.baseline_gate(s, base, "corpus_id", ["mean", "std"], 1)


@query("d4_time_budget", f"SELECT event_type, {sql_q6('540 * quantile_cont(value, 0.95) + 1800 + 900')} AS projected, 540 * quantile_cont(value, 0.95) + 2700 <= 64800 AS fits FROM events GROUP BY 1")
def _(v):
    p = 540 * F.percentile("value", F.lit(0.95)) + 2700
    return v.table("events").groupBy("event_type").agg(q6(p).alias("projected"), (p <= 64800).alias("fits"))


# --- expectations --------------------------------------------------------------------------------


@query("v1_uniqueness", "SELECT sent_text, count(*) AS n FROM sentences GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return checks.duplicates(v.sentences(), "sent_text")


@query("v4_baseline", "SELECT corpus_id, floor(mean * 1000 + 0.5) = floor(0.5 * 1000 + 0.5) AS mean_ok, floor(low * 1000 + 0.5) = floor(0.0 * 1000 + 0.5) AS low_ok, floor(mean * 1000 + 0.5) = 500 AND floor(low * 1000 + 0.5) = 0 AS ok FROM (SELECT corpus_id, avg(score) AS mean, min(score) AS low FROM scores GROUP BY 1)")
def _(v):
    s = v.scores().groupBy("corpus_id").agg(F.avg("score").alias("mean"), F.min("score").alias("low"))
    base = v.spark.createDataFrame([(c, 0.5, 0.0) for c in ("en", "de", "fr", "es")], "corpus_id string, mean double, low double")
    return checks.baseline_gate(s, base, "corpus_id", ["mean", "low"], 3)


@query("v5_bounds_sentinel", "SELECT corpus_id, count(*) FILTER (NOT percent BETWEEN 0 AND 100) AS out_of_bounds, count(DISTINCT percent) FILTER (no_unit) AS sentinel_values, count(*) FILTER (no_unit) AS sentinels FROM scores GROUP BY 1")
def _(v):
    p, flag = F.col("percent"), F.col("no_unit")
    return v.scores().groupBy("corpus_id").agg(F.count_if(~p.between(0, 100)).alias("out_of_bounds"), F.countDistinct(F.when(flag, p)).alias("sentinel_values"), F.count_if(flag).alias("sentinels"))


@query("v6_ordered_digest", "SELECT corpus_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM (SELECT corpus_id, b, count(*) AS n, sha256(string_agg(doc_path, chr(10) ORDER BY i)) AS h FROM (SELECT corpus_id, doc_path, i, i // 64 AS b FROM (SELECT corpus_id, doc_path, row_number() OVER (PARTITION BY corpus_id ORDER BY sha256(doc_path), doc_path) - 1 AS i FROM docs)) GROUP BY 1, 2) GROUP BY 1")
def _(v):
    from ..operators.order import row_number

    d = row_number(v.docs().select("corpus_id", "doc_path"), ["doc_path"], ["corpus_id"], "i", key=F.col("doc_path"))
    return checks.ordered_digest(d, "doc_path", ["i"], ["corpus_id"], block=64)


_NOTE = "CASE WHEN starts_with(sent_id, '0') THEN 'see ' || sent_id || ' in /home/' || corpus_id || '/notes' WHEN starts_with(sent_id, '1') THEN reverse(sent_id) || ' ' || sent_id || sent_id ELSE 'row ' || reverse(sent_id) END"


@query(
    "v7_privacy_scan",
    """SELECT file, "column", kind, "offset", count(*) AS n, count(DISTINCT value) AS different FROM (
    SELECT 'notes.csv' AS file, 'note' AS "column", 'value' AS kind, sent_id AS value, CAST(i - 1 AS BIGINT) AS "offset" FROM (SELECT note, unnest(range(1, length(note) - size + 2)) AS i, size FROM notes, sizes) JOIN (SELECT DISTINCT sent_id FROM sentences) ON substr(note, i, size) = sent_id
    UNION ALL SELECT 'notes.csv', 'note', 'path', regexp_extract(note, '/home/[^ ]+'), instr(note, '/home/') - 1 FROM notes WHERE contains(note, '/home/')
    UNION ALL SELECT 'counts.json', 'line', 'field', 'case_id', NULL FROM (SELECT DISTINCT corpus_id FROM sentences)) GROUP BY ALL""",
    notes=f"SELECT {_NOTE} AS note FROM sentences",
    sizes="SELECT DISTINCT length(sent_id) AS size FROM sentences",
)
def _(v):
    """A folder to be published, into whose notes and counts ids, a home path and a field have got, against all sentence ids."""
    from ..operators import privacy

    s, folder = sinks.written(v.sentences().select("corpus_id", "sent_id"), "ids", "zstd"), sinks.scratch(v.spark, "evidence")
    sinks.csv(s.select("corpus_id", F.expr(_NOTE.replace("starts_with", "startswith")).alias("note")), f"{folder}/notes.csv")
    s.groupBy("corpus_id").count().select(F.concat(F.lit('  "case_id": '), F.col("count").cast("string"))).write.text(f"{folder}/counts.json")
    found = privacy.leaks(v.spark, folder, s, "sent_id", ["case_id", "review_id"])
    return found.groupBy("file", "column", "kind", "offset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("different"))


@query("v11_packet_bijection", "SELECT edit_type, count(*) AS cases, count(DISTINCT sha256(concat_ws(chr(0), 'packet', CAST(case_id AS VARCHAR)))) AS ids FROM (SELECT DISTINCT case_id, edit_type FROM candidates) GROUP BY 1")
def _(v):
    from ..functions.text import namespaced_id

    c = v.candidates().select("case_id", "edit_type").distinct()
    return c.groupBy("edit_type").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct(namespaced_id(F.lit("packet"), F.col("case_id").cast("string"))).alias("ids"))


@query("v15_blinded_export", "SELECT case_id, slot, side FROM reviews")
def _(v):
    return checks.blinded(v.reviews(), ("case_id", "slot", "side"), ("delta", "score", "model", "rating"))


@query("v2_checksums", "SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels")
def _(v):
    parts = [v.table(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in ("documents", "labels")]
    return parts[0].union(parts[1])


# --- scorer adapter ------------------------------------------------------------------------------


@query("x1_scorer", f"SELECT sent_id, {sql_q6(sql_uniform('sent_id'))} AS score FROM sentences")
def _(v):
    from ..operators.scoring import HashScorer, score

    return score(v.sentences().select("sent_id", F.col("sent_id").alias("text")), HashScorer()).select("sent_id", q6(F.col("score")).alias("score"))


@query("x2_score_cache", "SELECT sent_id FROM sentences WHERE NOT starts_with(sent_id, '0')")
def _(v):
    from ..operators.scoring import unscored

    s = v.sentences().select("sent_id", F.col("sent_text").alias("text"))
    have = s.where(F.col("sent_id").startswith("0")).select("sent_id", F.sha2("text", 256).alias("content_id"))
    return unscored(s, have).select("sent_id")


@query("x10_rescore_edits", f"SELECT case_id, slot, {sql_q6(sql_uniform('edited') + ' - ' + sql_uniform('original'))} AS delta FROM pairs")
def _(v):
    from ..operators.scoring import HashScorer, score

    p = v.pairs()
    long = p.select("case_id", "slot", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("edited").alias("text")), F.struct(F.lit(-1).alias("sign"), F.col("original").alias("text")))).alias("x")).select("case_id", "slot", "x.sign", "x.text")
    return score(long, HashScorer()).groupBy("case_id", "slot").agg(q6(F.sum(F.col("sign") * F.col("score"))).alias("delta"))


@query("x11_fan_out", "SELECT scorer, count(*) AS n, count(DISTINCT sent_id) AS ids FROM (SELECT sent_id, unnest(['tokens', 'plain', 'csv']) AS scorer FROM sentences) GROUP BY 1")
def _(v):
    s = v.sentences().select("sent_id", F.explode(F.array(*map(F.lit, ("tokens", "plain", "csv")))).alias("scorer"))
    return s.groupBy("scorer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sent_id").alias("ids"))


@query("g1_resume_dedupe", "SELECT case_id, attempt, status FROM (SELECT case_id, attempt, status, min(attempt) FILTER (status = 'purchase') OVER (PARTITION BY case_id) AS done FROM attempts) WHERE done IS NULL OR attempt <= done")
def _(v):
    from ..streaming.attempts import resumable

    return resumable(v.attempts(), F.col("status") == "purchase").select("case_id", "attempt", "status")


@query("g1_stream", "SELECT case_id, attempt, status FROM attempts")
def _(v):
    """The same log as a stream: exactly one row of each key, though every file comes twice."""
    from ..streaming.attempts import deduplicated_log

    source = sinks.scratch(v.spark, "attempt-files")
    log = v.attempts().select("case_id", "attempt", "status", "ts")
    log.union(log).repartition(3).write.parquet(source)
    return deduplicated_log(v.spark, source, "case_id long, attempt long, status string, ts timestamp", sinks.scratch(v.spark, "attempt-log"), sinks.scratch(v.spark, "attempt-state")).select("case_id", "attempt", "status")


@query("g1_resumed_stream", "SELECT case_id, attempt, status FROM (SELECT case_id, attempt, status, min(attempt) FILTER (status = 'purchase') OVER (PARTITION BY case_id) AS done FROM attempts) WHERE done IS NULL OR attempt <= done")
def _(v):
    """The log as a stream without state: each file twice, with rows of another configuration, up to the accepted attempt."""
    from ..streaming.attempts import resumed_log

    source, sink = sinks.scratch(v.spark, "attempt-files"), sinks.scratch(v.spark, "attempt-log")
    log = v.attempts().select("case_id", "attempt", "status", F.lit("now").alias("config"))
    log.union(log).union(log.withColumn("config", F.lit("before"))).repartition(3).write.parquet(source)
    got = resumed_log(v.spark, source, "case_id long, attempt long, status string, config string", sink, f"{sink}-state", F.col("status") == "purchase", F.col("config") == "now")
    return got.select("case_id", "attempt", "status")


@query("g2_chain_stream", "SELECT CAST(case_id AS VARCHAR) AS chain, attempt AS place, 'changed' AS problem FROM attempts WHERE event_id % 89 = 5")
def _(v):
    """The chained log as a stream, its files dealt at random, with some states changed afterwards."""
    from ..operators import contracts
    from ..streaming import chains

    source, sink = sinks.scratch(v.spark, "chain-files"), sinks.scratch(v.spark, "chain-faults")
    log = contracts.chain_log(v.attempts().select("case_id", "attempt", "event_id", "status"), ["case_id"], "attempt", "status")
    log = log.withColumn("status", F.when(F.col("event_id") % 89 == 5, F.concat("status", F.lit("!"))).otherwise(F.col("status")))
    log.repartition(3, F.xxhash64("event_id")).write.parquet(source)
    before = v.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", chains.STORE)
    try:
        stream = v.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run = chains.faults(stream, "case_id", "attempt", "status").writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return v.spark.read.schema(chains.FAULTS).parquet(sink)


@query("g4_windows", f"SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01')) AS hour_ms, event_type, count(*) AS n, {sql_q6('sum(value)')} AS total FROM events GROUP BY 1, 2")
def _(v):
    from ..streaming.attempts import tumbling

    w = tumbling(v.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), q6(F.sum("value")).alias("total")])
    return w.select(F.unix_millis("window.start").alias("hour_ms"), "event_type", "n", "total")
