"""Sentence boundaries, their repair, and the rules for edited sentences, against plain Python versions."""

import itertools
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import segment
from tessera.functions import text as X
from tessera.operators import filters


def split(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["s"] for r in df.select("i", segment.sentences(F.col("t"), **options).alias("s")).orderBy("i").collect()]


CASES = [
    ("Good day. This is a test.", 2), ("Is it so? It is! Good.", 3), ("Dr. Smith et al. wrote, e.g. in Fig. 3, that U.S. rates rose.", 1), ("It was written by Ann E. Smith.", 1),
    ("The map is on p. 55 of vol. 2.", 1), ("Did Brown and co. build the bridge?", 1), ("It was built by Brown and co. They are gone.", 2), ("The path leads to Mt. Kenya first.", 1),
    ("At 5 a.m. Mr. Brown left. He came at 6 p.m. to the farm.", 3), ("It came from the U.S. How did it travel?", 2), ("It belongs to the U.S. Navy there.", 1), ("It costs $100.00 in version 1.2.3 of it.", 1),
    ('He turned, "This is great." and left.', 1), ('He said "This is great." She left.', 2), ("The house (it stood there. for years.) is gone.", 1), ("1. The first item. 2. The second item.", 2),
    ("a. one item\nb. two items\n\nand more", 3), ("Thoughts ... or not. And so... it goes.", 2), ("Stop! is what it says. Oh!! Then nothing.", 3), ("See www.example.com/a.b and x@y.z now. End.", 2),
    ("No. 5 is alive. Prof. Dr. J. K. Rowling spoke.", 2), ("It was approx. etc. fine.", 1), ("no end mark", 1), ("", 0), (" \n\t ", 0), ("So do I. The others too.", 2), ("\u201cOne. Two.\u201d Then (three. four.) five.", 2),
]


def test_boundaries(spark):
    for (text, n), got in zip(CASES, split(spark, [t for t, _ in CASES]), strict=True):
        assert len(got) == n, (text, got)
        assert "".join(got).replace(" ", "") == re.sub(r"\s", "", text)


def test_the_twin_without_look_around_says_the_same(spark):
    import random

    import duckdb

    from tessera.plans.views import sql_sentences

    pick = random.Random(11)
    parts = ["Dr", "etc", "e.g", "U.S", "a.m", "P.M", "I", "J", "x", "The", "word", "5", "12", "(", ")", '"', "”", "“", "'", ".", ".", ". ", ". ", "! ", "? ", "...", " ", " ", "\n", "No", "fig", "He", "Being", "é", "É", "?!", ".) ", '." ', "\t", ":", "-"]
    texts = [t for t, _ in CASES] + ["".join(pick.choice(parts) for _ in range(pick.randrange(30))) for _ in range(6000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, t VARCHAR)")
    import pandas as pd

    frame = pd.DataFrame({"i": range(len(texts)), "t": texts})
    con.execute("INSERT INTO t SELECT * FROM frame")
    for repaired in (True, False):
        want = dict(con.execute(f"SELECT i, {sql_sentences('t', repaired)} FROM t").fetchall())
        got = split(spark, texts, repaired=repaired)
        assert [(t, got[i], want[i]) for i, t in enumerate(texts) if got[i] != want[i]] == []
    assert len(frame) == len(texts)


def plain_repair(pieces):
    done = []
    for s in pieces:
        if done and (s in (")", ":", ";", ",", "-", "–", "—") or (len(s) <= 3 and s.endswith(":"))):
            done[-1] += " " + s
        else:
            done.append(s)
    out, i = [], 0
    while i < len(done):
        if len(done[i]) <= 3 and i + 1 < len(done) and unicodedata.category(done[i + 1][0]) == "Ll":
            out.append(f"{done[i]} {done[i + 1]}")
            i += 2
        else:
            out.append(done[i])
            i += 1
    return out


def test_repair_of_all_documents_and_of_fragments(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    fragments = [")", "a.", "b)", "é x", "x:", "No", "word one.", "Word two.", "1.", "—", "ab:", "abc:", "ß.", "A", ","]
    import random

    pick = random.Random(2)
    docs += ["\n".join(pick.choice(fragments) for _ in range(pick.randrange(12))) for _ in range(400)] + [None]
    before, after = split(spark, docs, repaired=False), split(spark, docs)
    assert before[-1] is None and after[-1] is None
    for raw, got in zip(before[:-1], after[:-1], strict=True):
        assert got == plain_repair(raw)
    assert sum(len(b) - len(a) for b, a in zip(before[:-1], after[:-1], strict=True)) > 500


def test_texts_that_hold_the_marks_lose_only_these(spark):
    assert split(spark, [f"One.{segment.HARD} Two{segment.DOT} x.{segment.BEGIN}"]) == [["One.", "Two x."]]


def test_a_long_text_takes_time_in_proportion(spark):
    text = "A sentence of some words, e.g. this one (with more. inside). " * 20_000
    assert len(split(spark, [text])[0]) == 20_000


# --- edited sentences ----------------------------------------------------------------------------


# What counts as a concrete marker, in Python's patterns.
MARKERS = {
    "address": r"(?i)https?://\S+",
    "path": r"(?<!\w)(?:[A-Za-z]:\\[^\s,;]+|/[^\s,;]+)",
    "flag": r"(?<!\w)--?[A-Za-z][A-Za-z0-9-]*",
    "number": r"(?<!\w)\d+(?:\.\d+)*(?!\w)",
    "snake": r"\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b",
    "camel": r"\b(?:[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*)\b",
    "code": r"`+([^`]+?)`+",
}


def plain_markers(t):
    out = []
    for kind, pattern in MARKERS.items():
        for found in re.findall(pattern, t):
            out.append(found.strip().casefold() if kind == "code" else found.casefold().rstrip(P.MARKER_TAIL))
    return sorted(filter(None, out))


def plain_tokens(t):
    """Word by word: a run of letters, digits and underscores, and further runs that one of - . / : ties to it."""
    out, at, t = [], 0, unicodedata.normalize("NFKC", t)
    inside = lambda i: i < len(t) and (t[i].isalnum() or t[i] == "_")
    while at < len(t):
        end = at
        while inside(end) or (end > at and end < len(t) and t[end] in "-./:" and inside(end + 1)):
            end += 1
        if end > at:
            out.append(t[at:end].casefold())
        at = max(end, at + 1)
    return out


def plain_integrity(original, edited):
    s = edited.strip()
    same = lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold()
    foreign = lambda t: any(unicodedata.category(c)[0] == "L" and ord(c) > 127 for c in t)
    tests = {
        "meta_prefix": s.casefold().startswith(P.META_PREFIXES), "multiple_sentences": len(re.findall(r"[.!?](?:[\"')\]]*)?(?=\s+[A-Z]|\s*$)", s)) > 1, "new_non_latin_script": not foreign(original) and foreign(s),
        "not_one_nonempty_line": not s or any(c in s for c in "\n\r\t"), "too_long_chars": len(s) > 2000, "too_short_chars": len(s) < 5, "unchanged_normalized": same(s) == same(original),
    }
    return [k for k, v in tests.items() if v]


ODD = [
    "Use the w3c ParseTree via well-known api2", "The cat sat down. The dog ran off.", "One end only.", "It's 3.14, v2 or 1.24a at C:\\dir\\x, /etc/hosts; --all -x a-b HTTPS://X.Y/Z). `Code Here` ``two``",
    "Straße STRASSE ﬁne ² x² Ⅷ İ ΣΑΣ", "a--b /a/ /b//c 1 2 3 4.5.6. x_y_ _z Ab aB AbC ABc aBé éaB", "", "   ", "`` ` x `", 'He left. "Why?" She said.) Then.', "測試 test", "You can't. You won't!",
]


def test_words_markers_and_integrity_of_all_turns(spark):
    turns = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("text is not null").orderBy("conv_id", "turn").collect()] + ODD
    pairs = list(zip(turns, turns[1:] + turns[:1], strict=True)) + [(t, f" {t.upper()} ") for t in ODD] + [(t, f"Here is {t}") for t in ODD]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, original string, edited string")
    o = F.col("original")
    got = df.select("i", X.edit_words(o).alias("words"), X.markers(o).alias("marks"), filters.integrity_reasons(o, F.col("edited")).alias("reasons")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert r["words"] == plain_tokens(a), a
        assert r["marks"] == plain_markers(a), a
        assert r["reasons"] == plain_integrity(a, b), (a, b)


@pytest.mark.parametrize(("original", "edited", "kind", "reasons"), [
    ("Reload the server after each release.", "Reload the apache 2.4 server after each release.", "add_specific", []), ("Reload apache 2.4 after each release.", "Reload the server after each release.", "de_specify", []),
    ("Reload apache 2.4 after each release.", "After each release, reload apache 2.4.", "irrelevant_rewrite", []), ("You may reload it.", "You must reload it now.", "add_specific", ["modality_changed"]),
    ("Never reload it.", "Reload it now.", "add_specific", ["polarity_changed"]), ("Reload it.", "Reload it now. Check the result.", "add_specific", ["multiple_sentences"]), ("Reload it.", "Reload it for проба.", "add_specific", ["new_non_latin_script"]),
])
def test_gates(spark, original, edited, kind, reasons):
    got = filters.gate(spark.createDataFrame([(original, edited, kind)], "original string, edited string, edit_type string")).first()["gate_reasons"]
    assert set(reasons) <= set(got) and (reasons or not got)


def test_only_pieces_that_change_are_repaired(spark):
    """The test for fragments is exact on every row of three pieces: short ones that stay as they are, most lists and tables, cost no pass over the text."""
    kinds = ("1.", "a b", "-x", ")", "ab:", "is.", "It is so.", "and so on.", "éa:", "—", "𝒳𝒳𝒳", "ß")
    rows = [(list(p),) for n in (1, 2, 3) for p in itertools.product(kinds, repeat=n)]
    df = spark.createDataFrame(rows, "p array<string>").select("p", segment.fragments(F.col("p")).alias("f"), segment.repair(F.col("p")).alias("r"))
    got = df.collect()
    assert all(r["f"] == (r["p"] != r["r"]) for r in got) and {r["f"] for r in got} == {True, False}
    assert not spark.createDataFrame([([],)], "p array<string>").select(segment.fragments(F.col("p"))).first()[0]
