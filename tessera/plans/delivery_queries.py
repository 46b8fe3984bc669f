"""Registered queries that write with a sink and read back, and on scorer adapters, payload schemas and provenance."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import q6
from ..operators import governance, scoring
from ..sources import archives, readers, sinks, workbooks
from .views import lit, sql, sql_q6, sql_uniform, sql_words

ALL: dict = {}


def query(name: str, text: str, **views: str):
    def add(make):
        ALL[name] = (make, sql(text, **views))
        return make

    return add


_MD = "corpus_id || '/' || doc_path || '.md'"


@query("s3_whole_documents", f"SELECT {_MD} AS path, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS digest FROM docs")
def _(v):
    root = sinks.scratch(v.spark, "whole")
    sinks.files(v.docs().select(F.concat("corpus_id", F.lit("/"), "doc_path", F.lit(".md")).alias("doc_path"), "content"), root)
    got = readers.documents(v.spark, root, ["**/*.md"])
    return got.select(F.col("doc_path").alias("path"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("digest"))


@query("s5_wiki_scan", "SELECT lpad(CAST(row_number() OVER (ORDER BY page_id % 2, page_id) AS VARCHAR), 4, '0') || '_page_' || page_id || '.txt' AS doc_path, 'page ' || page_id AS title FROM (SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0 ORDER BY page_id % 2, page_id LIMIT 50)")
def _(v):
    """Two sets of shards whose ids interleave. Every third page is a redirect and every fifth in another namespace; the first fifty others in the order of shards are read, which is the scan's own limit."""
    k = F.col("page_id")
    tail = F.when(k % 3 == 0, '<redirect title="x"/>').otherwise("")
    body = F.format_string("<page><id>%d</id><ns>%d</ns><title>page %d</title>%s<revision><text a='1'>text %d</text></revision></page>", k, F.when(k % 5 == 0, 1).otherwise(0), k, tail, k)
    root = sinks.scratch(v.spark, "dump")

    def shard(batches):  # a whole document in each file
        yield pa.RecordBatch.from_pydict({"value": ["<dump>"]})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])
        yield pa.RecordBatch.from_pydict({"value": ["</dump>"]})

    for name, half in (("b", 1), ("a", 0)):
        pages = v.table("pages").where(k % 2 == half).select("page_id", body.alias("value")).repartitionByRange(4, "page_id").sortWithinPartitions("page_id")
        pages.select("value").mapInArrow(shard, "value string").write.option("compression", "bzip2").text(f"{root}/{name}")
    return readers.wiki_pages(v.spark, root, 50).select("doc_path", "title")


@query("s8_last_score", f"SELECT sent_id, {sql_q6('least(score, score2)')} AS score FROM scores")
def _(v):
    """Each id has two lines, the greater score first: the last one holds."""
    s = v.scores().select("sent_id", F.explode(F.array(F.greatest("score", "score2"), F.least("score", "score2"))).alias("score"))
    path = sinks.scratch(v.spark, "scores-twice")
    s.write.option("sep", "\t").csv(path)
    return readers.scores(v.spark, path, "last").select("sent_id", q6(F.col("score")).alias("score"))


@query("s12_workbook", "SELECT CAST(case_id AS VARCHAR) AS case_id, max(CAST(slot AS VARCHAR)) AS slot, 0 AS changed FROM reviews GROUP BY 1")
def _(v):
    """A review packet, one row a case, handed off as workbooks and read back; only the column to be filled in comes back changed."""
    packet = v.reviews().groupBy(F.col("case_id").cast("string").alias("case_id")).agg(F.max(F.col("slot").cast("string")).alias("slot"))
    root = sinks.scratch(v.spark, "books")
    workbooks.hand_offs(packet, "case_id", ["slot"], root, 2000)
    found = workbooks.cells(v.spark, root)
    filled = found.withColumn("value", F.when((F.col("column") == "B") & (F.col("row") > 1), F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    differ = workbooks.changed(found, filled, ["B"]).groupBy("book", "sheet", "row").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = workbooks.table(found, ["case_id", "slot"]).withColumn("book", F.element_at(F.split("book", "/"), -1))
    return rows.join(differ, ["book", "sheet", "row"], "left").select("case_id", "slot", F.coalesce("n", F.lit(0)).alias("changed"))


_SENT = "SELECT DISTINCT CAST(case_id AS VARCHAR) || '/' || CAST(slot AS VARCHAR) AS id, case_id, edit_type, side, rating FROM reviews WHERE case_id IS NOT NULL AND slot IS NOT NULL"


@query(
    "s12_returned_workbooks",
    """SELECT id, 'B' AS "column", edit_type AS released, CASE WHEN case_id % 7 = 2 THEN upper(edit_type) END AS returned FROM sent WHERE case_id % 7 IN (2, 4)
    UNION ALL SELECT id, 'C', side, side || ' & <more>' FROM sent WHERE case_id % 11 = 3""",
    sent=_SENT,
)
def _(v):
    """Workbooks come back with ratings, which are for the reviewer to fill in, and with cells changed that are not: some rewritten, some emptied, some longer."""
    r, k = v.reviews(), F.col("case_id")
    sent = r.where("case_id is not null and slot is not null").select(F.concat(k.cast("string"), F.lit("/"), F.col("slot").cast("string")).alias("id"), "edit_type", "side", "case_id", "rating")
    sent = sinks.written(sent.distinct(), "sent")
    kind = F.when(k % 7 == 2, F.upper("edit_type")).when(k % 7 == 4, None).otherwise(F.col("edit_type"))
    side = F.when(k % 11 == 3, F.concat("side", F.lit(" & <more>"))).otherwise(F.col("side"))
    one, two = sinks.scratch(v.spark, "released"), sinks.scratch(v.spark, "returned")
    workbooks.hand_offs(sent.select("id", "edit_type", "side", F.lit(None).cast("string").alias("rating")), "id", ["edit_type", "side"], one, 2000)
    workbooks.hand_offs(sent.select("id", kind.alias("edit_type"), side.alias("side"), "rating"), "id", ["rating"], two, 2000)
    released = sinks.written(workbooks.cells(v.spark, one), "released-cells")
    differ = workbooks.changed(released, workbooks.cells(v.spark, two), ["D"])
    rows = workbooks.table(released, ["id"]).withColumn("book", F.element_at(F.split("book", "/"), -1))
    return differ.join(rows, ["book", "sheet", "row"]).select("id", "column", "released", "returned")


@query("k3_scorer_files", f"SELECT sent_id, array_to_string({sql_words('sent_text')}, ' ') AS tokens FROM sentences")
def _(v):
    path = sinks.scratch(v.spark, "scorer-input")
    s = v.sentences().select("sent_id", X.words(F.col("sent_text")).alias("words"))
    sinks.scorer_input(s, "sent_id", "words", path)
    parts = F.split("value", "\t", 2)
    return v.spark.read.text(path).select(parts[0].alias("sent_id"), parts[1].alias("tokens"))


@query("k3_legacy_bundle", "SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, 1 + (SELECT count(*) FROM documents) AS lines FROM documents")
def _(v):
    path = sinks.scratch(v.spark, "bundle")
    rows = sinks.legacy_bundle(v.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", path)
    lines = v.spark.read.text(f"{path}/target.txt").count()
    return rows.select("row", "doc_id", F.lit(lines).cast("long").alias("lines"))


_STAT = f"SELECT corpus_id, count(*) AS n, {sql_q6('avg(score)')} AS mean, {sql_q6('min(score)')} AS least FROM scores GROUP BY 1"


def _stats(v):
    return v.scores().groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"), q6(F.avg("score")).alias("mean"), q6(F.min("score")).alias("least"))


@query("k5_metadata", "SELECT 'docs' AS name, count(*) AS n FROM docs UNION ALL SELECT 'sentences', count(*) FROM sentences UNION ALL SELECT 'outputs', 1")
def _(v):
    path = sinks.scratch(v.spark, "out")
    _stats(v).coalesce(1).write.option("header", True).csv(path)
    outputs = governance.file_checksums(v.spark, f"{path}/part-*").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "sha256")
    body = json.loads(sinks.metadata({"docs": v.docs(), "sentences": v.sentences()}, {"a": 1}, outputs))
    return v.spark.createDataFrame([*body["rows"].items(), ("outputs", len(body["outputs"]))], "name string, n long")


@query("k6_publish", _STAT)
def _(v):
    """Written once, copied and compared by hash; the copy is what is read."""
    first, second = sinks.scratch(v.spark, "first"), sinks.scratch(v.spark, "second")
    _stats(v).write.option("header", True).csv(first)
    sinks.publish(v.spark, first, second)
    return readers.csv(v.spark, second, "corpus_id string, n long, mean double, least double")


@query("k9_report", r"SELECT corpus_id, printf('%s & %d & %.3f & %.3f \\', corpus_id, n, mean, least) AS tex, printf('| %s | %d | %.3f | %.3f |', corpus_id, n, mean, least) AS md FROM stat", stat=_STAT)
def _(v):
    rows = sorted(map(tuple, _stats(v).collect()))
    one = v.spark.createDataFrame(rows, "corpus_id string, n long, mean double, least double").coalesce(1)
    tex, md = sinks.latex(one).split("\n"), sinks.markdown(one, "Scores").split("\n")[4:]
    return v.spark.createDataFrame([(r[0], t, m) for r, t, m in zip(rows, tex, md, strict=False)], "corpus_id string, tex string, md string")


@query("k14_edit_tables", "SELECT edit_type, CAST(count(*) AS VARCHAR) AS n, coalesce(printf('%.9f', CASE WHEN edit_type <> 'de_specify' THEN mean END), '') AS mean FROM (SELECT edit_type, count(*) OVER (PARTITION BY edit_type) AS n, floor(avg(delta) OVER (PARTITION BY edit_type) * 1e6 + 0.5) / 1e6 AS mean FROM candidates) GROUP BY edit_type, mean")
def _(v):
    """One direction's mean is left undefined: its cell is blank."""
    c = v.candidates()
    stats = c.groupBy("edit_type").agg(F.count(F.lit(1)).alias("n"), q6(F.avg("delta")).alias("mean")).withColumn("mean", F.when(F.col("edit_type") != "de_specify", F.col("mean")))
    root = sinks.scratch(v.spark, "edits")
    sinks.edit_tables(c.select("case_id", "slot", "edit_type"), c, stats, root)
    back = v.spark.read.option("header", True).schema("edit_type string, n string, mean string").option("nullValue", "\x00").csv(f"{root}/stats")
    return back.select("edit_type", "n", F.coalesce("mean", F.lit("")).alias("mean"))


_RULES = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}}


@query("m2_schema", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 3 THEN '$: k is missing' WHEN CAST(props ->> 'k' AS BIGINT) < 10 THEN '$.k: below 10' WHEN CAST(props ->> 'k' AS BIGINT) > 60 THEN '$.k: above 60' END AS problem FROM events) GROUP BY 1")
def _(v):
    """Payloads against a JSON Schema; every seventh has lost its key."""
    e = v.table("events").select(F.when(F.col("event_id") % 7 == 3, "{}").otherwise(F.col("props")).alias("props"))
    return governance.payload_errors(e, "props", _RULES).select(F.explode_outer("errors").alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("v13_provenance", "SELECT corpus_id, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum(CAST(('0x' || substr(sha256(doc_path || chr(10) || sha256(content)), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM docs GROUP BY 1")
def _(v):
    d = v.docs().select("corpus_id", F.col("doc_path").alias("path"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    known = [r["corpus_id"] for r in d.select("corpus_id").distinct().collect()]  # a row a corpus
    record = json.loads(governance.provenance(d, {c: {"type": "table"} for c in known}))
    return v.spark.createDataFrame([(c, r["files"], r["bytes"], str(int(r["digest"], 16))) for c, r in record.items()], "corpus_id string, files long, bytes long, digest string")


@query("x3_runs", f"SELECT run_id, count(*) AS n, {sql_q6('avg(score)')} AS mean FROM (SELECT unnest([1, 2, 3]) AS run_id, unnest([{', '.join(sql_uniform(lit(f'run{i}') + ' || sent_id') for i in (1, 2, 3))}]) AS score FROM sentences) GROUP BY 1")
def _(v):
    rows = v.sentences().select("sent_id", F.col("sent_id").alias("text"))
    got = scoring.runs(rows, [scoring.Salted(f"run{i}") for i in (1, 2, 3)], allowed=True)
    return got.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), q6(F.avg("score")).alias("mean"))


_ADAPTED = f"""SELECT corpus_id, run_id, u - avg(u) OVER (PARTITION BY corpus_id, run_id) AS score FROM
(SELECT corpus_id, unnest([1, 2, 3]) AS run_id, unnest([{', '.join(sql_uniform(f"'adapted{i}:' || sent_id") for i in (1, 2, 3))}]) AS u FROM sentences)"""


def _adapted_runs(v):
    """Three runs of an adapter that takes each corpus as its target: its scores are what its surrogate gives, less the mean over the whole corpus."""
    rows = v.sentences().select("sent_id", "corpus_id", F.col("sent_id").alias("text"))
    return scoring.runs(rows, [scoring.Shifted("adapted", seed) for seed in (1, 2, 3)], allowed=True, key="sent_id", by="corpus_id")


@query("x3_adapted_runs", f"SELECT corpus_id, run_id, count(*) AS n, {sql_q6('max(score)')} AS most, {sql_q6('avg(abs(score))')} AS distance FROM adapted GROUP BY 1, 2", adapted=_ADAPTED)
def _(v):
    return _adapted_runs(v).groupBy("corpus_id", "run_id").agg(F.count(F.lit(1)).alias("n"), q6(F.max("score")).alias("most"), q6(F.avg(F.abs("score"))).alias("distance"))


@query("x3_run_variability", f"SELECT corpus_id, {sql_q6('min(m)')} AS least, {sql_q6('max(m)')} AS most, {sql_q6('stddev_pop(m)')} AS sd FROM (SELECT corpus_id, run_id, avg(abs(score)) AS m FROM adapted GROUP BY 1, 2) GROUP BY 1", adapted=_ADAPTED)
def _(v):
    """The spread of the runs' mean distances, as for any scorer that is run several times."""
    means = _adapted_runs(v).groupBy("corpus_id", "run_id").agg(F.avg(F.abs("score")).alias("m"))
    return means.groupBy("corpus_id").agg(q6(F.min("m")).alias("least"), q6(F.max("m")).alias("most"), q6(F.stddev_pop("m")).alias("sd"))


@query("x4_percentiles", "SELECT corpus_id, no_unit, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, CAST(floor(avg(CASE WHEN units > 0 THEN units * 0.25 END) * 1e6 + 0.5) / 1e6 AS DOUBLE) AS percent FROM (SELECT corpus_id, units, units = 0 AS no_unit FROM (SELECT corpus_id, length(regexp_replace(sent_text, '[^ ]', '', 'g')) AS units FROM sentences)) GROUP BY 1, 2")
def _(v):
    got = scoring.percentiles(v.sentences().select("corpus_id", F.col("sent_text").alias("text")), scoring.Blanks())
    return got.groupBy("corpus_id", "result.no_unit").agg(F.count(F.lit(1)).alias("n"), F.sum("result.units").alias("units"), q6(F.avg("result.percent")).alias("percent"))


@query("x12_covered", f"SELECT count(*) AS n, {sql_q6('sum(' + sql_uniform('sent_id') + ')')} AS total FROM sentences")
def _(v):
    """Identity, scores and coverage, as one call."""
    ask = {"tag": "hash", "digest": "1"}
    got = scoring.covered(v.sentences().select("sent_id", F.col("sent_id").alias("text")), scoring.HashScorer(), "sent_id", lambda: governance.preflight(ask, {"tag": "hash"}, ("hash", ["hash"])))
    return got.agg(F.count(F.lit(1)).alias("n"), q6(F.sum("score")).alias("total"))


def _again(texts: list[str], attempt: int) -> list[str]:
    """A surrogate editor: each attempt says one thing more."""
    return [f"{t} and {'more ' * attempt}" for t in texts]


@query("x6_editor", "SELECT case_id, slot, attempt, length(original) AS chars, attempt = need AS accepted FROM (SELECT case_id, slot, original, need, unnest(range(1, least(need, 3) + 1)) AS attempt FROM (SELECT *, 1 + length(original) % 5 AS need FROM pairs))")
def _(v):
    """Cases are accepted at the attempt that their text's length asks for, from 1 to 5; three are made at most."""
    wanted = 1 + F.length("original") % 5
    more = F.regexp_count("edited", F.lit("more ")) - F.regexp_count("original", F.lit("more "))
    gate = lambda d: d.withColumn("gate_reasons", F.when(more == wanted, F.array().cast("array<string>")).otherwise(F.array(F.lit("too_little"))))
    cases = v.pairs().select("case_id", "slot", "original")
    log = scoring.edited(cases, _again, gate, ["case_id", "slot", "original"])
    return log.select("case_id", "slot", F.col("attempt").cast("long").alias("attempt"), F.length("original").cast("long").alias("chars"), "accepted")


@query("s1_manifest", "SELECT DISTINCT corpus_id AS id, corpus_id || '/**/*.md' AS include, 2 AS globs, '**/skip.md' AS exclude FROM docs")
def _(v):
    known = sorted(r["corpus_id"] for r in v.docs().select("corpus_id").distinct().collect())  # a row a corpus
    text = "corpora:\n" + "".join(f"  - id: {c}  # a language\n    include:\n      - '{c}/**/*.md'\n      - more/*.rst\n    exclude: ['**/skip.md']\n" for c in known)
    rows = [(m["id"], m["include"][0], len(m["include"]), m["exclude"][0]) for m in readers.manifest(text)]
    return v.spark.createDataFrame(rows, "id string, include string, globs int, exclude string")


@query("s13_archive_member", _STAT)
def _(v):
    """A table's rows as members of a packed archive, each read back by its name."""
    rows = _stats(v).select(F.lit("stats.zip").alias("archive"), F.concat(F.lit("stats/"), "corpus_id", F.lit(".json")).alias("name"), F.to_json(F.struct("*")).alias("content"))
    root = sinks.scratch(v.spark, "stats")
    archives.packed(rows, root)
    back = archives.members(v.spark, root, "stats/*.json").select(F.from_json(F.decode("content", "utf-8"), "corpus_id string, n long, mean double, least double").alias("r"))
    return back.select("r.*")


_SHARD = "'docs-' || CAST(CAST('0x' || substr(sha256(doc_path), 1, 4) AS BIGINT) % 16 AS VARCHAR) || '.zip'"


@query("s13_archive_members", f"SELECT {_SHARD} AS archive, {_MD} AS name, CAST(strlen(content) AS BIGINT) AS size_bytes, CAST(strlen(content) // 4096 + CASE WHEN strlen(content) % 4096 > 0 OR strlen(content) = 0 THEN 1 ELSE 0 END AS BIGINT) AS pieces, sha256(content) AS sha256 FROM docs")
def _(v):
    """All documents as members of sixteen archives, read back in pieces of up to 4 KB."""
    shard = F.conv(F.substring(F.sha2("doc_path", 256), 1, 4), 16, 10).cast("long") % 16
    docs = v.docs().select(F.concat(F.lit("docs-"), shard.cast("string"), F.lit(".zip")).alias("archive"), F.concat("corpus_id", F.lit("/"), "doc_path", F.lit(".md")).alias("name"), "content")
    root = sinks.scratch(v.spark, "archives")
    archives.packed(docs, root)
    found = archives.members(v.spark, root, piece=4096, block=1 << 20)
    whole = found.groupBy("archive", "name", "size_bytes").agg(F.count(F.lit(1)).alias("pieces"), F.max("sha256").alias("sha256"))
    return whole.withColumn("archive", F.element_at(F.split("archive", "/"), -1))


@query("v8_archive_contract", f"SELECT archive, name, CASE WHEN h % 5 = 0 THEN 'missing' WHEN h % 5 = 1 THEN 'not in the contract' ELSE 'differs' END AS problem FROM (SELECT {_SHARD} AS archive, {_MD} AS name, CAST('0x' || substr(sha256(doc_path), 5, 4) AS BIGINT) AS h FROM docs) WHERE h % 5 < 3")
def _(v):
    """Archives against the hashes that were promised: of five documents one was not packed, one not promised, and one packed with another text."""
    part = lambda i: F.conv(F.substring(F.sha2("doc_path", 256), i, 4), 16, 10).cast("long")
    docs = v.docs().select(F.concat(F.lit("docs-"), (part(1) % 16).cast("string"), F.lit(".zip")).alias("archive"), F.concat("corpus_id", F.lit("/"), "doc_path", F.lit(".md")).alias("name"), "content", (part(5) % 5).alias("h"))
    root = sinks.scratch(v.spark, "promised")
    archives.packed(docs.where("h <> 0").select("archive", "name", F.when(F.col("h") == 2, F.concat("content", F.lit("."))).otherwise(F.col("content")).alias("content")), root)
    return archives.bound(archives.members(v.spark, root), docs.where("h <> 1").select("archive", "name", F.sha2("content", 256).alias("sha256")))


@query("m3_override", "SELECT event_type, count(*) AS n FROM events WHERE value >= 25.5 GROUP BY 1")
def _(v):
    """A protocol's bound replaced at its pointer, which is one of those that may be; then applied."""
    protocol = governance.override({"bounds": {"value": [1.0, 99.0]}}, {"/bounds/value/0": 25.5}, {"/bounds/value/0"})
    governance.frozen(protocol, {"bounds": {"value": [25.5, 99.0]}})
    return v.table("events").where(F.col("value") >= protocol["bounds"]["value"][0]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
