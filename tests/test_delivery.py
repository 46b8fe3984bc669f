"""Staging, scorer adapters, publishing, notes, workbooks, reports: over local servers, files and a stub repository."""

import hashlib
import http.server
import json
import os
import random
import re
import subprocess
import sys
import threading
import urllib.error
import urllib.parse
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, governance, privacy, scoring
from tessera.sources import connect, readers, sinks


@pytest.fixture
def server():
    """Answers with what ``reply(path, body)`` gives: (status, value)."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def _answer(self, body):
            status, value = self.server.reply(self.path, body)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):  # noqa: N802
            self._answer(None)

        def do_POST(self):  # noqa: N802
            self._answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

        def log_message(self, *args):
            pass

    held = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    held.url = f"http://127.0.0.1:{held.server_address[1]}"
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield held
    held.shutdown()


def test_paged_source(spark, server):
    pages = [(i, f"{p}{i // 2}", f"text {i}" if i != 4 else "") for p in "ab" for i in range(9)]
    calls = []

    def reply(path, _):
        ask = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(path).query).items()}
        calls.append(ask)
        if len(calls) == 1:
            return 429, {}
        own = [p for p in pages if p[1].startswith(ask["gapprefix"])]
        at, n = int(ask.get("gapcontinue", 0)), int(ask["gaplimit"])
        body = {"query": {"pages": {str(i): {"pageid": i, "title": t, "extract": x} for i, t, x in own[at : at + n]}}}
        return 200, body | ({"continue": {"gapcontinue": at + n}} if at + n < len(own) else {})

    server.reply = reply
    spark.dataSource.register(connect.PagedPages)
    got = spark.read.format("paged_pages").option("url", server.url).option("start", "a,b").option("batch", 2).option("wait", 0.01).load()
    # The first page of a title stays; empty ones go.
    want = {(i, f"{p}{i // 2}", f"text {i}") for p in "ab" for i in (0, 2, 5, 6, 8)}
    assert set(map(tuple, got.collect())) == want
    assert spark.read.format("paged_pages").option("url", server.url).option("start", "a").option("limit", 3).option("batch", 2).load().count() == 3


def test_json_is_asked_for_again_only_when_the_server_is_busy(server):
    waits, answers = [], [429, 503, 200]
    server.reply = lambda *_: (answers.pop(0), {"a": 1})
    assert connect.get_json(server.url, sleep=waits.append) == {"a": 1} and waits == [1.0, 2.0]
    answers[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        connect.get_json(server.url, sleep=waits.append)
    answers[:] = [429] * 5
    with pytest.raises(urllib.error.HTTPError):
        connect.get_json(server.url, sleep=waits.append)


def test_staging(tmp_path, server):
    origin, clone = tmp_path / "origin", tmp_path / "clone"
    env = os.environ | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "x"), ("EMAIL", "x@y.z"))}
    subprocess.run(["git", "init", "-q", str(origin)], check=True)
    (origin / "a.md").write_text("x")
    subprocess.run(["git", "-C", str(origin), "add", "."], check=True)
    subprocess.run(["git", "-C", str(origin), "commit", "-qm", "one"], check=True, env=env)
    assert not connect.present(str(clone), "repository")
    head = connect.repository(f"file://{origin}", str(clone))
    assert (clone / "a.md").read_text() == "x" and connect.repository("nowhere", str(clone), head) == head
    with pytest.raises(checks.Violation):
        connect.repository("nowhere", str(clone), "0" * 40)
    server.reply = lambda *_: (200, "body")
    connect.download(server.url, str(tmp_path / "d/x.json"))
    server.reply = lambda *_: (500, "never asked")
    connect.download(server.url, str(tmp_path / "d/x.json"))
    assert json.loads((tmp_path / "d/x.json").read_text()) == "body" and os.listdir(tmp_path / "d") == ["x.json"]
    for name, ok in (("good/a.txt", True), ("../bad.txt", False)):
        with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
            z.writestr(name, "1")
        if ok:
            connect.unpack(str(tmp_path / "z.zip"), str(tmp_path / "out"))
            connect.unpack(str(tmp_path / "missing.zip"), str(tmp_path / "out"))
            assert (tmp_path / "out/good/a.txt").read_text() == "1"
        else:
            with pytest.raises(checks.Violation):
                connect.unpack(str(tmp_path / "z.zip"), str(tmp_path / "other"))
            assert not (tmp_path / "other").exists()


PROGRAM = "import sys\nif '--help' in sys.argv: sys.exit(0)\nsource, target = sys.argv[-2:]\nopen(target, 'w').writelines(f'{len(line.split())}\\n' for line in open(source, encoding='utf-8'))\n"


def test_command_scorer(spark, tmp_path):
    (tmp_path / "program.py").write_text(PROGRAM)
    scorer = scoring.Command("words", [sys.executable, str(tmp_path / "program.py")])
    scorer.preflight()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c\nd e", "", None, "é ü ö ß"])], "k long, text string")
    got = {r["k"]: r["score"] for r in scoring.covered(df, scorer, "k").collect()}
    assert got == {0: 2, 1: 3, 2: 0, 3: 0, 4: 4}
    (tmp_path / "short.py").write_text(PROGRAM.replace("in open(source, encoding='utf-8')", "in list(open(source))[1:]"))
    with pytest.raises(Exception, match="gave 4 scores for 5"):
        scoring.score(df.coalesce(1), scoring.Command("short", [sys.executable, str(tmp_path / "short.py")])).collect()
    with pytest.raises(checks.Violation, match="ended with"):
        scoring.Command("none", [sys.executable, str(tmp_path / "missing.py")])(["x"])
    with pytest.raises(checks.Violation, match="does not start"):
        scoring.Command("none", [sys.executable, str(tmp_path / "missing.py")]).preflight()


def test_judge(spark, server):
    schema = {"type": "object", "required": ["score"], "properties": {"score": {"type": "number", "minimum": 0, "maximum": 1}}}
    asked = []

    def reply(_, body):
        asked.append(body)
        text = body["messages"][0]["content"]
        said = "no json" if len(asked) == 1 else json.dumps({"score": len(text) / 100 if "bad" not in text else 7})
        return 200, {"message": {"content": said}}

    server.reply = reply
    judge = scoring.Judge("m", server.url, "Judge: {text}", schema)
    assert judge(["abc"]) == [0.1] and len(asked) == 2 and asked[0] == asked[1] and asked[0]["options"] == {"seed": 7, "temperature": 0}
    assert judge.steady(["a", "b"])
    df = spark.createDataFrame([("a", "abc"), ("b", "abcd")], "k string, text string")
    assert {r["k"]: r["score"] for r in scoring.score(df, judge).collect()} == {"a": 0.1, "b": 0.11}
    with pytest.raises(checks.Violation, match="above 1"):
        judge(["bad"])


def test_batches_have_the_size_asked_for(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        name = "counting"

        def __call__(self, texts):
            if len(texts) == 25_000:
                seen.add(1)
            return [float(len(texts))] * len(texts)

    got = scoring.score(spark.range(60_000).coalesce(1).selectExpr("cast(id as string) AS text"), Counting()).groupBy("score").count().collect()
    assert {(r["score"], r["count"]) for r in got} == {(25_000.0, 50_000), (10_000.0, 10_000)} and seen.value == 2
    small = list(scoring.gathered(iter([pa.record_batch({"x": list(range(i))}) for i in (3, 4, 0, 9)]), 5))
    assert [b.num_rows for b in small] == [5, 5, 5, 1] and [x for b in small for x in b.column(0).to_pylist()] == [*range(3), *range(4), *range(9)]
    assert len(list(scoring.gathered(iter([pa.record_batch({"x": ["long" * 100] * 8})] * 3), 100, most=10))) == 3


class Ordered:
    """An adapter whose state turns on the order of texts and of merges: a digest of all of them."""

    name, seed = "ordered", 1

    def start(self):
        return b""

    def fold(self, state, texts):
        for t in texts:
            state = hashlib.sha256(state + t.encode()).digest()
        return state

    def merge(self, left, right):
        return hashlib.sha256(b"m" + left + right).digest()

    def score(self, state, texts):
        return [float(int.from_bytes(hashlib.sha256(state + t.encode()).digest()[:4], "big")) for t in texts]


def test_adapters_see_whole_targets_whatever_the_partitions(spark):
    rows = [(i, ("en", "de", "fr")[i % 3] if i < 1500 else "en", None if i % 97 == 0 else f"text {i % 700}") for i in range(2000)] + [(5, "fr", "text 5")] * 3
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    found = []
    for n in (1, 7, 200):
        got = scoring.score_adapted(df.repartition(n), Ordered(), "id", "lang", block=40)  # 25 blocks of "en": two levels of the tree
        found.append(sorted((r["id"], r["lang"], r["text"] or "", r["score"]) for r in got.collect()))
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    parts = scoring.score_adapted(df, Ordered(), "id", "lang", block=40, most=1)  # a broadcast for each target
    assert sorted((r["id"], r["lang"], r["text"] or "", r["score"]) for r in parts.collect()) == found[0]
    shifted = scoring.score_adapted(df, scoring.Shifted("s", 3), "id", "lang", block=40)
    for r in shifted.groupBy("lang").avg("score").collect():
        assert abs(r[1]) < 1e-12
    with pytest.raises(checks.Violation, match="fewer than 50"):
        scoring.score_adapted(df.where("lang <> 'de' OR id < 100"), Ordered(), "id", "lang")
    with pytest.raises(checks.Violation, match="which key and target"):
        scoring.runs(df, [Ordered()], allowed=True)
    runs = scoring.runs(df, [scoring.Shifted("s", i) for i in (1, 2, 3)], allowed=True, key="id", by="lang")
    assert runs.groupBy("run_id").count().collect() and runs.select("id", "score").where("id = 1").distinct().count() == 3


def plain_leaks(cells, values, names):
    out = []
    for file, column, text in cells:
        out += [(file, column, "value", v, i) for v in set(filter(None, values)) for i in range(len(text)) if text.startswith(v, i)]
        out += [(file, column, "field", n, None) for n in names if re.search(rf"""^\s*["']?{n}["']?\s*[:=,]\s*(?!false\b|null\b|none\b)""", text.lower(), re.M)]
        out += [(file, column, "path", m[0], m.start()) for m in re.finditer(r"""(?:[A-Za-z]:\\Users\\|/home/|/Users/)[^\s"']+""", text, re.I)]
    return out


def test_privacy_scan_equals_a_search_for_every_value(spark, tmp_path):
    rng = random.Random(4)
    word = lambda n, abc="ab🙂": "".join(rng.choice(abc) for _ in range(n))
    values = [word(n) for n in (1, 2, 3, 5, 7, 8, 12, 15, 16, 17, 24, 40, 300) for _ in range(4)] + ["", None, "needle in many places", "a" * 20]
    notes = [word(rng.randint(0, 60)) + (rng.choice(values) or "") + word(rng.randint(0, 30)) for _ in range(60)] + ["a" * 50, 'quoted "x", and\na second line', "C:\\Users\\me\\x /home/you 'z"]
    spark.createDataFrame([(i, t) for i, t in enumerate(notes)], "review_id long, note string").write.option("header", True).option("escape", '"').csv(f"{tmp_path}/out/notes.csv")
    spark.createDataFrame([(values[5], None), (None, "x")], "kept string, other string").write.parquet(f"{tmp_path}/out/table.parquet")
    lines = ['{"case_id": 5, "b": "/Users/me/data"}', '  "case_id": null', "Case_Id = 7", "see case_id", "needle in many places needle in many places"]
    (tmp_path / "out/run.json").write_text("\n".join(lines))
    got = [tuple(r) for r in privacy.leaks(spark, f"{tmp_path}/out", spark.createDataFrame([(v,) for v in values], "v string"), "v", ["case_id", "review_id"]).collect()]
    cells = [("notes.csv", "note", t) for t in notes if t] + [("notes.csv", "review_id", str(i)) for i in range(len(notes))] + [("table.parquet", "kept", values[5]), ("table.parquet", "other", "x")] + [("run.json", "line", t) for t in lines]
    want = plain_leaks(cells, values, ["case_id", "review_id"]) + [("notes.csv", "review_id", "field", "review_id", None)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and {k for _, _, k, _, _ in got} == {"value", "field", "path"}
    assert privacy.leaks(spark, f"{tmp_path}/out", spark.createDataFrame([], "v string"), "v", []).where("kind <> 'path'").count() == 0


def test_privacy_scan_looks_only_where_a_value_fits():
    """Sixty-four characters after five others can begin at six places, whose windows choose two k-grams here, not fourteen."""
    hashes = privacy._grams("note " + "".join(random.Random(1).choice("0123456789abcdef") for _ in range(64)), 8)
    every, some = (privacy._chosen(hashes, 9, n).tolist() for n in (10**6, 6))
    assert set(some) <= set(every) and len(some) <= 3 < len(every)
    assert all(any(p <= i < p + 9 for i in some) for p in range(6)) and max(some) < 6 + 8
    assert not len(privacy._chosen(hashes[:8], 9, 6)) and not len(privacy._chosen(hashes, 9, 0))


def test_privacy_scan_of_ids(spark, tmp_path):
    """Ids in long texts of every kind, over the ends of stretches, repeated and next to each other; the folder is read once."""
    ids = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(400)]
    rng = random.Random(7)
    notes = [f"see {x} in /HOME/{i}/notes" if i % 3 == 0 else f"{x[::-1]} {x}{x}" if i % 3 == 1 else f"row {x[::-1]}" for i, x in enumerate(ids)]
    notes += ["".join(rng.choice([rng.choice(ids), "🙂é", "-" * 70, rng.choice(ids)[:60]]) for _ in range(1500)), ids[3] * 9, "ab" * 200, "CASE_ID: 1", "/U\u017fers/x \u0130", ""]
    spark.createDataFrame([(t,) for t in notes], "note string").coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/out/notes.csv")
    values = [*ids, *ids[:100], "ab" * 32, "-" * 64, "-" * 65, ids[5] + ids[6], "é-"]
    found = privacy.leaks(spark, f"{tmp_path}/out", spark.createDataFrame([(v,) for v in values], "v string"), "v", ["case_id"])
    got, want = sorted(map(str, map(tuple, found.collect()))), sorted(map(str, plain_leaks([("notes.csv", "note", t) for t in notes if t], values, ["case_id"])))
    assert got == want and len(got) > 3000
    assert "FileScan csv" not in found._jdf.queryExecution().toString()


def test_privacy_filters_are_for_millions_of_values(spark):
    """Ids hardly share a k-gram, whatever their number, and a filter of many is not full."""
    ids = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50000)]
    places, hashes, offsets = privacy._anchors(ids)
    assert privacy.CLASSES[places[0]][1] == 32 and len(set(hashes.tolist())) == len(ids) and offsets.max() == 32
    some, other = hashes[:25000], hashes[25000:]
    for n in (25000, 20_000_000):  # the filter's size, and that of many pieces
        bloom = privacy._bloom(spark.createDataFrame([(h,) for h in some.view("int64").tolist()], "hash long"), n)
        assert len(bloom) * 64 >= 12 * n and privacy._passes(bloom, some).all() and privacy._passes(bloom, other).mean() < 0.05


def test_runs_and_coverage(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "k long, text string")
    with pytest.raises(checks.Violation, match="only where"):
        scoring.runs(df, [scoring.HashScorer()])
    with pytest.raises(checks.Violation, match="at least 50"):
        scoring.runs(df.limit(49), [scoring.HashScorer()], allowed=True)
    assert scoring.runs(df, [scoring.HashScorer()] * 3, allowed=True).groupBy("run_id").count().count() == 3

    class Broken:
        name = "broken"

        def __call__(self, texts):
            return [float("nan")] * len(texts)

    with pytest.raises(checks.Violation, match="not scored"):
        scoring.covered(df, Broken(), "k")
    with pytest.raises(checks.Violation, match="another model"):
        scoring.covered(df, scoring.HashScorer(), "k", lambda: governance.preflight({"tag": "x"}, {"tag": "y"}))
    with pytest.raises(checks.Violation, match="besides"):
        governance.preflight({"tag": "x"}, {"tag": "x"}, ("x", ["x", "other"]))
    got = scoring.percentiles(spark.createDataFrame([("a b c",), ("a",), (None,)], "text string"), scoring.Blanks()).select("text", "result.*").collect()
    assert [(r["percent"], r["units"], r["no_unit"]) for r in got] == [(0.5, 2, False), (None, 0, True), (None, 0, True)]


def test_publish_and_notes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    df.write.option("header", True).csv(f"{tmp_path}/one")
    got = sinks.publish(spark, f"{tmp_path}/one", f"{tmp_path}/two/deep")
    assert got.count() == len([f for f in os.listdir(tmp_path / "one") if f.endswith(".csv")])
    assert spark.read.option("header", True).csv(f"{tmp_path}/two/deep").count() == 2
    with pytest.raises(checks.Violation, match="differs"):
        (tmp_path / "two/deep/stale.csv").write_text("x")
        sinks.publish(spark, f"{tmp_path}/one", f"{tmp_path}/two/deep")
    with pytest.raises(checks.Violation, match="nothing"), sinks.qa_note(spark, f"{tmp_path}/notes/qa.txt"):
        sinks.refuse_empty(df.limit(0))
    assert (tmp_path / "notes/qa.txt").read_text() == "QA failed: nothing to write\n"
    with sinks.qa_note(spark, f"{tmp_path}/notes/none.txt"):
        sinks.refuse_empty(df)
    assert os.listdir(tmp_path / "notes") == ["qa.txt"] or "none.txt" not in os.listdir(tmp_path / "notes")
    for bad in ("../x", "/x", "a/../../x"):
        with pytest.raises(Exception, match="leaves its root"):
            sinks.files(spark.createDataFrame([(bad, "x")], "doc_path string, content string"), f"{tmp_path}/f").collect()


def test_legacy_bundle(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", f"text\n{i}") for i in (3, 1, 2)], "k string, t string").repartition(3)
    rows = sinks.legacy_bundle(df, "k", "t", f"{tmp_path}/b").collect()
    assert sorted((r["row"], r["k"]) for r in rows) == [(1, "k1"), (2, "k2"), (3, "k3")]
    read = lambda n: [r[0] for r in spark.read.text(f"{tmp_path}/b/{n}").collect()]
    assert read("target.txt") == ["text 1", "text 1", "text 2", "text 3"] and read("labels.txt") == ["0"] * 4


def test_workbooks(spark):
    packet = spark.createDataFrame([("b", "x < y & z", 2.5, None), ("a", " lead", 1.0, None)], "id string, text string, n double, answer string")
    book = sinks.hand_off(packet, "id", ["text"])
    assert book == sinks.hand_off(packet.orderBy(F.desc("id")), "id", ["text"])
    cells = readers.xlsx(book)
    assert cells == {"A1": "id", "B1": "text", "C1": "n", "D1": "answer", "A2": "a", "B2": " lead", "C2": "1.0", "A3": "b", "B3": "x < y & z", "C3": "2.5"}
    assert readers.sheet(cells)[1] == {"id": "b", "text": "x < y & z", "n": "2.5", "answer": None}
    assert readers.changed_cells(cells, cells | {"D2": "5"}, ("D",)) == []
    assert readers.changed_cells(cells, {k: v for k, v in cells.items() if k != "C3"} | {"B2": "other", "D1": "x"}, ("D",)) == ["B2", "C3", "D1"]
    with pytest.raises(checks.Violation, match="not complete"):
        sinks.hand_off(packet, "id", ["answer"])
    with pytest.raises(checks.Violation, match="more than 1 rows"):
        sinks.hand_off(packet, "id", ["text"], most=1)
    assert list(readers.xlsx(sinks.workbook([], [f"c{i}" for i in range(28)])))[-2:] == ["AA1", "AB1"]


def test_reports_and_figures(spark):
    df = spark.createDataFrame([("a_b", 1.23456, 3), ("50%", None, 4)], "name string, x double, n int")
    assert sinks.latex(df) == "a\\_b & 1.235 & 3 \\\\\n50\\% & -- & 4 \\\\"
    assert sinks.markdown(df, "T", "note").split("\n")[4:7] == ["| name | x | n |", "| --- | --- | --- |", "| a_b | 1.235 | 3 |"][0:3] or "| a_b | 1.235 | 3 |" in sinks.markdown(df, "T", "note")
    with pytest.raises(checks.Violation, match="more than"):
        sinks.latex(df, most=1)
    from xml.etree import ElementTree

    for svg in (sinks.histogram_svg([(0, 3), (1, 0)], "a < b"), sinks.histogram_svg([], "none"), sinks.facets_svg({"en": [(0, 1)], "de": [(0, 2), (1, 4)]}, "f"), sinks.curve_svg([(0.1, 0.5), (0.3, 0.2)], "c"), sinks.curve_svg([], "c"),
                sinks.gaps_svg([("x", 0.1, -0.1, 0.2)], "g"), sinks.gaps_svg([], "g"), sinks.boxes_svg({"a": (0, 1, 2, 3, 4), "b": (1, 1, 1, 1, 1)}, "b")):
        ElementTree.fromstring(svg)
    assert sinks.facets_svg({"en": [(0, 1)], "de": [(0, 2), (1, 4)]}, "f").count("<rect") == 3


@pytest.mark.parametrize(("value", "schema", "errors"), [
    (3, {"type": "integer"}, []), (True, {"type": ["integer", "null"]}, ["$: not of type integer/null"]), (2.0, {"type": "integer"}, []), (None, {"type": "null"}, []),
    ({"a": [1, "x"]}, {"properties": {"a": {"items": {"type": "string"}}}}, ["$.a[0]: not of type string"]), ("abc", {"minLength": 4, "pattern": "^b"}, ["$: 3 characters", "$: does not match ^b"]), (5, {"minLength": 9}, []),
    ([1, 1], {"uniqueItems": True, "maxItems": 1}, ["$: repeated items", "$: 2 items"]), ({"b": 1}, {"additionalProperties": {"type": "string"}}, ["$.b: not of type string"]), (1, {"exclusiveMinimum": 1, "maximum": 0}, ["$: not above 1", "$: above 0"]),
    (True, {"enum": [1]}, ["$: not one of [1]"]), ({"a": 1}, {"const": {"a": 1}}, []), (1, {"title": "only said"}, []),
])
def test_schema_keywords(value, schema, errors):
    assert governance.schema_errors(value, schema) == errors


def test_schema_keywords_that_are_not_checked_are_refused(spark):
    for schema in ({"$ref": "#/x"}, {"properties": {"a": {"oneOf": []}}}):
        with pytest.raises(ValueError, match="not checked"):
            governance.schema_errors({"a": 1}, schema)
    df = spark.createDataFrame([('{"k": 1}',), ("{",), (None,)], "p string")
    assert [r["errors"] for r in governance.payload_errors(df, "p", {"required": ["j"]}).collect()] == [["$: j is missing"], ["$: no JSON"], ["$: no JSON"]]


def test_provenance(spark):
    files = spark.createDataFrame([("a", "x", 3, "1" * 64), ("a", "y", 4, "2" * 64), ("b", "z", 5, "3" * 64)], "corpus_id string, path string, size_bytes long, sha256 string")
    one = governance.provenance(files, {"a": {"type": "git"}, "b": {"type": "zip"}})
    assert one == governance.provenance(files.orderBy(F.desc("path")), {"b": {"type": "zip"}, "a": {"type": "git"}})
    assert json.loads(one)["a"]["files"] == 2 and json.loads(one)["a"]["bytes"] == 7
    with pytest.raises(checks.Violation, match="differ"):
        governance.provenance(files, {"a": {}})
