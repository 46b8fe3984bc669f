"""Every registered query with SQL against DuckDB on the small tables, and the pieces that SQL cannot say."""

import json
import math
import random
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import normalise, segment, treebank
from tessera.functions import patterns as P
from tessera.functions import text as X
from tessera.operators import agreement, checks, estimate, filters, governance, ladders, order, scoring, selection, summary
from tessera.plans import pipeline, registry
from tessera.sources import readers, sinks
from tessera.streaming import attempts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    rel = duck.sql(registry.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_entry(spark):
    assert registry.entry(spark, SF).count() == 4


def test_repair(spark):
    fix = lambda parts: one(spark, segment.repair(F.col("p")), p=parts)
    assert fix(["Install the package.", ")", "Done."]) == ["Install the package. )", "Done."]
    assert fix(["a.", "install it.", "b.", "Stop."]) == ["a. install it.", "b.", "Stop."]
    assert fix(["x.", "y.", "z is."]) == ["x. y.", "z is."]
    assert fix([")", "Yes."]) == [")", "Yes."]
    assert fix([]) == []


@pytest.mark.parametrize(("text", "codes"), [
    ("The quick brown fox jumps over it.", []), ("Use {{ name }} in this template now.", ["template_markup"]), ("`whole row is code here ok`", ["code_markup"]), ("a | b | c | d are the columns", ["table_markup"]),
    ("See https://example.com for more about this.", ["url"]), ("$ pip install --user package/name/x", ["command_path_dominated"]), ("## A heading with several more words", ["heading_fragment"]),
    ("- an item without any end mark", ["list_fragment"]), ("Too short here.", ["very_short_fragment"]), ("1 2 3 4 5 6 a b", ["low_alphabetic_content"]), ("[[a|b]] and [[c|d]] are both links here.", []), ("", ["very_short_fragment", "low_alphabetic_content"]),
])
def test_strict_rule(spark, text, codes):
    df = filters.strict(spark.createDataFrame([(text,), (None,)], "sent_text string"))
    rows = df.collect()
    assert rows[0]["reason_codes"] == codes and rows[0]["keep"] == (not codes)
    assert rows[1]["reason_codes"] == ["very_short_fragment", "low_alphabetic_content"]


def test_alpha_ratio_edge(spark):
    assert one(spark, X.alpha_ratio(F.col("t")), t="abc12") == 0.6 and not one(spark, filters.low_alphabetic_content(F.col("t")), t="abc12")


def test_text_functions(spark):
    assert one(spark, treebank.treebank(F.col("t")), t="They don't (really) cannot say \"no\", ok.") == ["They", "do", "n't", "(", "really", ")", "can", "not", "say", "``", "no", "''", ",", "ok", "."]
    assert one(spark, X.markers(F.col("t")), t="run `Foo Bar` --all in src/x or /x, snake_case 3.14") == sorted(["foo bar", "--all", "/x", "snake_case", "3.14"])
    assert one(spark, X.slug(F.col("t")), t="A / strange: title!") == "A_strange_title" and one(spark, X.slug(F.col("t")), t="!!") == "untitled"
    assert one(spark, normalise.markdown_to_text(F.col("t")), t="---\na: b\n---\n# Head\n\n```\ncode\n```\n- item `x`\n") == "Head\n \nitem `x`".replace("\n \n", "\n")
    assert one(spark, normalise.html_to_text(F.col("t")), t="<p>a <code>b</code><pre>no</pre> &amp; c</p><script>x</script>") == "a b & c"
    assert one(spark, normalise.rst_to_text(F.col("t")), t=".. note:: x\n\ntext\n.. code-block:: c\n\n   int\nAfter\n") == "text\nAfter"


def test_ranks_and_quantiles_match_numpy(spark):
    draw = np.random.default_rng(0)
    values = {"a": draw.integers(0, 9, 500).astype(float), "b": draw.random(301), "c": np.array([1.0])}
    df = spark.createDataFrame([(g, i, float(x)) for g, v in values.items() for i, x in enumerate(v)] + [("a", -1, None)], "g string, i long, x double")
    got = {r["g"]: r for r in order.quantiles(df, "x", ["g"], {"p": 0.275, "m": 0.5, "z": 1.0}, 7).collect()}
    for g, v in values.items():
        assert [got[g][k] for k in ("p", "m", "z")] == pytest.approx(np.quantile(v, [0.275, 0.5, 1.0]).tolist())
    ranks = {(r["g"], r["i"]): r["rank"] for r in order.average_rank(df, "x", ["g"]).collect()}
    for g, v in values.items():
        assert [ranks[g, i] for i in range(len(v))] == [((v < x).sum() + 1 + (v <= x).sum()) / 2 for x in v]
    assert order.average_rank(df.limit(0), "x", ["g"]).count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.01, 0.5, 0.58, 0.999, 1.0)], "corpus_id string, v double")
    n = {r["bin"]: r["n"] for r in summary.histogram(df, "v", ("corpus_id",)).collect()}
    edges = np.histogram([0, 0.01, 0.5, 0.58, 0.999, 1], bins=np.arange(51) * 0.02)[0]
    assert len(n) == 50 and [n[i] for i in range(50)] == edges.tolist()


def test_distribution_values(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.0, 0.1, 0.5, 0.9, 1.0)], "corpus_id string, v double")
    r = summary.distribution(df, "v", ("corpus_id",)).first()
    assert (r["distinct_values"], r["mode_value"], r["utilisation"]) == (5, 0.0, 1.0) and r["tie_rate"] == pytest.approx(1 / 6) and r["mode_share"] == pytest.approx(2 / 6)


def test_ols_matches_numpy(spark):
    draw = np.random.default_rng(1)
    x, g = draw.normal(size=400), draw.integers(0, 25, 400)
    y = 1 + 2 * x + draw.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, g, strict=True)], "x double, y double, g long")
    fit = estimate.cluster_ols(df, "y", {"one": F.lit(1.0), "x": F.col("x")}, "g")
    d = np.stack([np.ones(400), x], 1)
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    e = y - d @ beta
    s = np.array([(d[g == k] * e[g == k, None]).sum(0) for k in np.unique(g)])
    inv = np.linalg.inv(d.T @ d)
    cov = inv @ s.T @ s @ inv * 25 / 24 * 399 / 398
    assert fit["beta"] == pytest.approx(beta) and fit["cov"] == pytest.approx(cov) and fit["clusters"] == 25
    assert estimate.contrast(fit, {"x": 1.0})[:2] == pytest.approx((beta[1], math.sqrt(cov[1, 1])))
    with pytest.raises(ValueError, match="rank"):
        estimate.cluster_ols(df, "y", {"one": F.lit(1.0), "two": F.lit(2.0)}, "g")
    assert fit["rank"] == 2
    assert estimate.heterogeneous([0.1, -0.01]) and not estimate.heterogeneous([0.1, 0.15])


def test_least_squares_of_a_design_near_to_singular(spark, monkeypatch):
    """Powers of a narrow range: X'X would lose all digits of it; factors are merged in two steps of the tree."""
    monkeypatch.setattr(estimate, "_FAN", 3)
    draw = np.random.default_rng(2)
    x = 1 + draw.random(900) / 50
    d = np.stack([x**k for k in range(4)], 1)
    y = d @ [1.0, -2.0, 3.0, 0.5] + draw.normal(size=900) / 1e6
    df = spark.createDataFrame([(float(a), float(b), i % 30) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, g long").repartition(11)
    fit = estimate.cluster_ols(df, "y", {f"x{k}": F.pow(F.col("x"), F.lit(float(k))) for k in range(4)}, "g")
    want = np.linalg.lstsq(d, y, rcond=None)[0]
    assert 1e7 < fit["condition"] < 1e9 and fit["rank"] == 4
    assert np.abs(d @ fit["beta"] - d @ want).max() < 1e-9 and fit["beta"] == pytest.approx(want, rel=1e-5)
    assert estimate.triangle(df.select("x", "y").limit(0)).shape == (0, 2)


def test_draws_are_multinomial_and_stable(spark):
    units = spark.createDataFrame([("a", str(i)) for i in range(40)], "g string, k string")
    got = estimate.draws(units, "k", ["g"], 30).collect()
    again = estimate.draws(units.repartition(7), "k", ["g"], 30).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert {r["rep"]: 0 for r in got}.keys() == set(range(30)) and sum(r["w"] for r in got) == 30 * 40


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (3, 3), (None, 1)], "a int, b int")
    r = agreement.kappa(df, "a", "b", []).first()
    o = np.array([[1, 1, 0], [0, 1, 0], [1, 0, 1]]) / 5
    e = np.outer(o.sum(1), o.sum(0))
    gap = np.abs(np.subtract.outer(range(3), range(3))) / 2
    for name, w in (("kappa", gap > 0), ("kappa_linear", gap), ("kappa_quadratic", gap**2)):
        assert r[name] == pytest.approx(1 - (w * o).sum() / (w * e).sum())
    assert agreement.kappa(df.where("a = 1 and b = 1"), "a", "b", []).first()["kappa"] is None


def test_review_orientation(spark):
    df = spark.createDataFrame([(s, r) for s in "AB" for r in "12345X"], "side string, rating string")
    got = [r["d"] for r in df.select("side", "rating", agreement.review_delta(F.col("rating"), F.col("side")).alias("d")).orderBy("side", "rating").collect()]
    assert got == [2, 1, 0, -1, -2, None, -2, -1, 0, 1, 2, None]


@pytest.mark.parametrize(("args", "label"), [((0.1, 0.1, 0.05, 0.15, True), "heterogeneous"), ((0.1, -0.1, -0.15, -0.05, False), "reversed"), ((0.1, 0.05, -0.01, 0.1, False), "eliminated"), ((0.1, 0.05, 0.04, 0.06, False), "attenuated"), ((0.1, 0.1, 0.05, 0.15, False), "persistent")])
def test_gap_ladder(spark, args, label):
    assert spark.range(1).select(ladders.gap_category(*map(F.lit, args)).alias("x")).first()["x"] == label


def test_gate(spark):
    rows = [("Set the limit to 5 in config_file now.", "Set the limit to 5 in config_file now with --force.", "add_specific"), ("Use --all now.", "Use it now.", "add_specific"), ("You must not stop.", "You must stop.", "irrelevant_rewrite"), ("same text", "Same  TEXT", "irrelevant_rewrite")]
    got = [r["gate_reasons"] for r in filters.gate(spark.createDataFrame(rows, "original string, edited string, edit_type string")).collect()]
    assert got[0] == [] and "original_concrete_marker_lost" in got[1] and "polarity_changed" in got[2] and "unchanged_normalized" in got[3]


def test_searches_before_patterns_change_no_flag(spark):
    pick = random.Random(4)
    parts = ["https://", "FTP://x", "wWw.a", "MailTo:b", "www.", "```", "`", "<code>", "</PRE >", "[[a|b]]", "|", "---|---", "#", " # h", "- ", "12) ", "\t", " ", "\u2028", "\x85", "\x0b", "a=b", "--x", "\\\\s", "./y", "$ ", ">>> ", "PS> ", "git", "Wörter", "9", ".", "?"]
    texts = ["", " ", *("".join(pick.choice(parts) for _ in range(pick.randrange(1, 7))) for _ in range(1500))]
    t = F.col("t")
    flags = {
        "url": (filters.url(t), t.rlike(P.URL)), "heading": (filters.heading_fragment(t), t.rlike(P.HEADING)), "code": (filters.code_markup(t), filters.inline_code(t) | t.rlike(P.CODE_TAG)),
        "list": (filters.list_fragment(t), t.rlike(P.LIST_ITEM) & ~X.strip(t).rlike(r"[.?!]\z")), "words": (F.size(X.words(t)), F.size(F.filter(F.split(t, rf"{P.BLANK}+"), lambda w: w != ""))),
        "shell": (filters.command_evidence(t), F.size(F.filter(X.words(t), filters.shell_syntax)) + filters._led(X.words(t)).cast("int")),
        "letters": (X.alpha_ratio(t), F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, P.BLANK, ""))), F.lit(0.0))),
    }
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *(F.struct(a.alias("got"), b.alias("want")).alias(k) for k, (a, b) in flags.items())).collect()
    assert [(k, r["t"]) for r in rows for k in flags if r[k]["got"] != r[k]["want"]] == []
    # A blank before a line separator that ends a text stays, as in SQL.
    got = spark.createDataFrame([(" a \u2028",), ("b \f",), (" ",)], "t string").select(X.strip(t)).collect()
    assert [r[0] for r in got] == ["a \u2028", "b", ""]


def test_strict_join_and_expectations(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, 1.0), (3, 2.0)], "k int, b double")
    with pytest.raises(checks.Violation, match="same"):
        checks.strict_join({"a": a, "b": b}, "k")
    with pytest.raises(checks.Violation, match="duplicate"):
        checks.strict_join({"a": a.union(a), "b": b}, "k")
    assert checks.strict_join({"a": a.where("k = 1"), "b": b.where("k = 1")}, "k").count() == 1
    with pytest.raises(checks.Violation):
        checks.blinded(a.withColumnRenamed("a", "model_name"), ("k", "model_name"), ("model",))


def test_sample_operators_keep_texts_unique(spark):
    rows = [("c", f"s{i:03d}", i / 100, f"t{i // 2}") for i in range(100)]
    got = selection.spot_check(spark.createDataFrame(rows, "g string, k string, s double, t string"), "s", "k", "t", ["g"], 8, 6).collect()
    texts = {r[1]: r[3] for r in rows}
    assert len(got) == 14 and len({texts[r["k"]] for r in got}) == 14


def test_readers(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("id\tnote\tvalue\na\tq\t0.1\nb\tw\t0.2\n\n")
    assert {(r.sent_id, r.score) for r in readers.sniffed_scores(spark, f"{tmp_path}/x.tsv").collect()} == {("a", 0.1), ("b", 0.2)}
    (tmp_path / "y.tsv").write_text("a\t1\t2\nb\t3\t4\n")
    with pytest.raises(checks.Violation, match="numeric"):
        readers.sniffed_scores(spark, f"{tmp_path}/y.tsv")
    (tmp_path / "p.txt").write_text("tensor(0.25)\n0.5\n")
    assert sorted(r.value for r in readers.predictions(spark, f"{tmp_path}/p.txt").collect()) == [0.25, 0.5]
    (tmp_path / "d.tsv").write_text("a\t0.1\na\t0.2\n")
    with pytest.raises(checks.Violation):
        readers.scores(spark, f"{tmp_path}/d.tsv")
    assert readers.scores(spark, f"{tmp_path}/d.tsv", "last").count() == 1
    (tmp_path / "w.xml").write_text("<m><page><id>2</id><ns>0</ns><title>B c</title><revision><text a='1'>two</text></revision></page><page><id>1</id><ns>0</ns><title>A</title><redirect title='x'/><revision><text a='1'>r</text></revision></page><page><id>3</id><ns>1</ns><title>T</title><revision><text a='1'>t</text></revision></page></m>")
    assert [(r.doc_path, r.content) for r in readers.wiki_pages(spark, f"{tmp_path}/w.xml", 5).collect()] == [("0001_B_c.txt", "two")]
    page = lambda i: f"<page><id>{i}</id><ns>0</ns><title> P{i} </title><revision><text a='1'>text {i}</text></revision></page>"
    for name, ids in (("dump-b", (1, 4, 6)), ("dump-a", (5, 2)), ("dump-c", (0, 3))):  # ids interleave, and are out of order in a shard
        (tmp_path / "shards").mkdir(exist_ok=True)
        (tmp_path / f"shards/{name}.xml").write_text("<m>" + "".join(map(page, ids)) + page(9).replace("text 9", " ") + "</m>")
    for n in (2, 4, 100):
        assert [r.doc_path for r in readers.wiki_pages(spark, f"{tmp_path}/shards", n).orderBy("doc_path").collect()] == [f"{i:04d}_P{p}.txt" for i, p in enumerate((5, 2, 1, 4, 6, 0, 3), 1)][:n]
    assert readers.wiki_pages(spark, f"{tmp_path}/shards/none*", 3).count() == 0
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>hello</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c><c r="C1" t="inlineStr"><is><t>X</t></is></c></row></sheetData></worksheet>')
    assert readers.xlsx((tmp_path / "b.xlsx").read_bytes()) == {"A1": "hello", "B1": "5", "C1": "X"}
    packed = sinks.archive({"b/x.csv": b"1", "a": b"2"})
    assert packed == sinks.archive({"a": b"2", "b/x.csv": b"1"}) and readers.archive_member(packed, "b/x.csv") == b"1"
    for bad in ("../x", "/x", "C:x"):
        with pytest.raises(checks.Violation):
            readers.check_names([(bad, False)])
    assert readers.manifest("corpora:\n  - id: one  # first\n    include:\n      - '**/*.md'\n      - a/*.rst\n    exclude: [x/**, y]\n  - id: two\n") == [{"id": "one", "include": ["**/*.md", "a/*.rst"], "exclude": ["x/**", "y"]}, {"id": "two"}]


def test_governance():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 5}, "b": {"type": "array", "items": {"enum": ["x", "y"]}}}}
    assert governance.schema_errors({"a": 3, "b": ["x"]}, schema) == []
    assert len(governance.schema_errors({"a": True, "b": ["z"], "c": 1}, schema)) == 3
    assert governance.override({"a": {"b": [1, 2]}}, {"/a/b/1": 9}, {"/a/b/1"}) == {"a": {"b": [1, 9]}}
    with pytest.raises(checks.Violation):
        governance.override({"a": 1}, {"/a": 2}, set())
    assert governance.canonical_sha256({"b": 1, "a": [1, 2]}) == governance.canonical_sha256(json.loads('{"a": [1, 2], "b": 1}'))
    assert governance.disposition({"x": "1"}, {"x": "1"}, {"p": False}, {"p"}) == "waived"


def test_attempt_logs(spark):
    log = spark.createDataFrame([(1, 1, "no"), (1, 2, "yes"), (1, 3, "no"), (2, 1, "no"), (3, 2, "no")], "case_id long, attempt long, status string")
    ok = F.col("status") == "yes"
    assert attempts.resumable(log, ok).count() == 4
    with pytest.raises(checks.Violation):
        attempts.validate(log, ok)
    cases = spark.createDataFrame([(1,), (2,), (4,)], "case_id long")
    assert {(r.case_id, r.next_attempt) for r in attempts.pending(cases, log, ok, 3).collect()} == {(2, 2), (4, 1)}


def test_scorer_contract(spark):
    class Short:
        name = "short"

        def __call__(self, texts):
            return [0.5] * (len(texts) - 1)

    df = spark.createDataFrame([("a", "x"), ("b", None)], "sent_id string, text string")
    assert scoring.score(df, scoring.HashScorer()).count() == 2
    with pytest.raises(Exception, match="gave"):
        scoring.score(df, Short()).collect()


def test_pipeline_from_files(spark, tmp_path):
    (tmp_path / "in/docs/sub").mkdir(parents=True)
    for i in range(30):
        (tmp_path / f"in/docs/sub/{i}.md").write_text(f"# Title {i}\n\nThis is sentence number {i} of the file. Another one follows it here! Run `x --flag` in dir/{i}.\n\n```\ncode\n```\n")
    (tmp_path / "in/docs/skip.md").write_text("no")
    out = pipeline.run(spark, "- id: docs\n  include: ['**/*.md']\n  exclude: ['skip.md']\n", f"{tmp_path}/in", f"{tmp_path}/out")
    assert out["sentences"].select("doc_path").distinct().count() == 30
    assert out["scores"].count() == out["features"].count() == out["sentences"].count() == out["strict_manifest"].count()
    assert out["score_stats"].first()["score_count"] == out["scores"].count()


def test_the_rest_imports_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_contracts(spark):
    from tessera.operators import contracts

    rows = [("a", "en", "x"), ("b", "en", " "), ("c", "en", None), (None, "en", "x"), (None, None, "y"), ("d", "de", "x\ny"), ("e", "de", "x"), ("e", "fr", "z")]
    df = spark.createDataFrame(rows, "sent_id string, corpus_id string, text string")
    got = sorted((r["sent_id"] or "", r["problem"] or "") for r in contracts.scorer_input(df).collect())
    assert got == [("", "blank_key"), ("", "blank_key"), ("a", ""), ("b", "blank_text"), ("c", "blank_text"), ("d", "newline"), ("e", "duplicate"), ("e", "duplicate")]
    assert contracts.scorer_input(df.limit(0)).count() == 0
    with pytest.raises(checks.Violation):
        contracts.scorer_input(df.withColumn("more", F.lit(1)))

    pairs = spark.createDataFrame([(1, 1, "k", "a", None), (1, 2, "other", "a", "b")], "case_id long, slot long, edit_type string, original string, edited string")
    assert [r["complete"] for r in contracts.edit_cases(pairs.where("slot = 1"), ("k",)).collect()] == [False]
    with pytest.raises(Exception, match="unknown edit type other"):
        contracts.edit_cases(pairs, ("k",)).collect()

    one_ = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, None)], "k long, v double")
    assert contracts.replayed(one_, one_.repartition(3)).first()["same"] and contracts.replayed(one_.limit(0), one_.limit(0)).first()["rows"] == 0
    assert not contracts.replayed(one_, one_.distinct()).first()["same"]
    near = contracts.recomputed(one_.distinct(), spark.createDataFrame([(1, 0.5 + 1e-9), (2, 3.0)], "k long, v double"), ["k"], ["v"])
    assert {r["k"]: r["within"] for r in near.collect()} == {1: True, 2: False}

    digests = "k long, d string"
    audit = contracts.return_audit(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (None, "n")], digests), spark.createDataFrame([(1, "a"), (2, "x"), (4, None), (4, None), (5, "e"), (None, "n")], digests), "k", "d")
    assert {r["k"]: r["problem"] for r in audit.collect()} == {2: "changed", 3: "missing", 4: "repeated", 5: "unknown"}

    held = spark.createDataFrame([("x", "0" * 64), (None, None)], "t string, h string")
    assert contracts.rehash(held, "t", "h").count() == 2
    step = contracts.lockstep(spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long"), "k")
    assert sorted((r["k"] or 0, r["side"]) for r in step.collect()) == [(0, "left"), (1, "left"), (2, "both"), (3, "right")]


@pytest.mark.parametrize(("bound", "failed", "want"), [("y", [], "accepted"), ("y", ["short"], "waived"), ("y", ["short", "private"], "withheld"), ("n", [], "withheld"), (None, [], "withheld")])
def test_disposition_of_rows(spark, bound, failed, want):
    from tessera.operators import contracts

    assert one(spark, contracts.disposition(F.col("b") == "y", F.col("f"), F.array(F.lit("short"))), b=bound, f=failed) == want


def test_a_changed_log_is_found(spark):
    from tessera.operators import contracts

    log = contracts.chain_log(spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c"), ("w", 1, None)], "u string, n long, s string"), ["u"], "n", "s")
    assert contracts.tampered(log, ["u"], "n", "s").count() == 0
    changed = log.withColumn("s", F.when((F.col("u") == "u") & (F.col("n") == 2), "x").otherwise(F.col("s")))
    assert [(r["u"], r["n"]) for r in contracts.tampered(changed, ["u"], "n", "s").collect()] == [("u", 2)]
    # A row taken out breaks the link of the row after it.
    assert [(r["u"], r["n"]) for r in contracts.tampered(log.where("n <> 2 or u <> 'u'"), ["u"], "n", "s").collect()] == [("u", 3)]
    done = contracts.completed(log, "u", "n", F.col("s"), ("c",))
    assert {r["u"]: (r["ended"], r["complete"]) for r in done.collect()} == {"u": (True, True), "w": (False, False)}


def test_whole_documents_are_listed_and_read_by_tasks(spark, tmp_path):
    """Thousands of files to a task instead of some thirty, none of them in the driver's plan, and empty ones too, which Spark's binary files leave out."""
    for name in ("a.md", "x/b c.md", "x/y/ü.md", "x/y/_hidden.md", "x/.dot.md", "x/y/n.txt", "_aside/z.md", "x/empty.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else name.encode() + b"\xff!")
    got = readers.documents(spark, str(tmp_path), ["**/*.md"], ["**/b*"])
    assert "binaryFile" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["doc_path"]: r["content"] for r in got.collect()}
    assert rows == {"a.md": "a.md!", "x/y/ü.md": "x/y/ü.md!", "x/empty.md": ""}
