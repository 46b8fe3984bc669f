"""The derived tables that the registered queries start from, in Spark and as SQL of the same name.

Corpora are the languages of ``documents``; a path is a document's id; scores are deterministic
surrogates made from a sentence's id, as no scorer model is part of the engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import segment as S
from ..functions import text as X
from ..functions.numeric import q6
from ..operators import filters, sentences
from ..sources.sinks import written


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all cores if the source has fewer splits than the cluster has cores; a large source stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Views:
    """Tables of one scale directory; each is read with the columns a query asks for and nothing is cached.

    ``held``: for queries that use the sentences three times or more. They are cut and scored once, written, and read again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, held: bool = False):
        self.spark, self.dir, self.held, self._written = spark, sf_dir, held, None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def docs(self) -> DataFrame:
        d = self.table("documents").where("text is not null and lang is not null")
        return spread(d.select(F.col("lang").alias("corpus_id"), F.col("doc_id").cast("string").alias("doc_path"), F.col("text").alias("content")))

    def sentences(self) -> DataFrame:
        return self.scores().select("corpus_id", "doc_path", "sent_idx", "sent_text", "sent_id") if self.held else sentences.sentence_table(self.docs())

    def scores(self) -> DataFrame:
        if not self.held:
            return self._scores()
        if self._written is None:
            self._written = written(self._scores(), "scores")
        return self._written

    def _scores(self) -> DataFrame:
        s = sentences.sentence_table(self.docs())
        ratio = X.alpha_ratio(F.col("sent_text"))
        return s.withColumns({"score": X.uniform(F.col("sent_id")), "score2": X.uniform(F.lit("run2"), F.col("sent_id")), "score3": X.uniform(F.lit("run3"), F.col("sent_id")), "percent": q6(100 * ratio), "no_unit": ~F.col("sent_text").rlike(r"\p{L}")})

    def strict(self) -> DataFrame:
        return filters.strict(self.scores())

    def pairs(self) -> DataFrame:
        """Original and edited text: a user's turn and the next turn of the conversation."""
        c = self.table("conversations").where("text is not null")
        first = c.where("role = 'user'").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("slot"), F.col("text").alias("original"))
        after = c.select(F.col("conv_id").alias("case_id"), (F.col("turn") - 1).alias("slot"), F.col("text").alias("edited"))
        kinds = F.array(*map(F.lit, P.EDIT_TYPES))
        return first.join(after, ["case_id", "slot"]).withColumn("edit_type", F.element_at(kinds, (F.pmod(F.col("slot"), F.lit(3)) + 1).cast("int")))

    def candidates(self) -> DataFrame:
        """``case_id, slot, edit_type, metric, delta``: every turn of a conversation as a candidate under three metrics."""
        c = self.table("conversations").where("text is not null")
        kinds = F.array(*map(F.lit, P.EDIT_TYPES))
        metrics = F.explode(F.array(*map(F.lit, ("a", "b", "c")))).alias("metric")
        c = c.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("slot"), F.element_at(kinds, (F.pmod(F.col("conv_id"), F.lit(3)) + 1).cast("int")).alias("edit_type"), metrics)
        return c.withColumn("delta", q6(X.uniform(F.col("metric"), F.col("case_id").cast("string"), F.col("slot").cast("string")) - 0.5))

    def reviews(self) -> DataFrame:
        """``case_id, slot, edit_type, side, rating``: one rating, 1 to 5 or X, of every candidate."""
        c = self.candidates().where("metric = 'a'")
        u = X.uniform(F.lit("review"), F.col("case_id").cast("string"), F.col("slot").cast("string"))
        ratings = F.array(*map(F.lit, ("1", "2", "3", "4", "5", "X")))
        return c.select("case_id", "slot", "edit_type", "delta", F.when(F.pmod(F.col("case_id") + F.col("slot"), F.lit(2)) == 0, "A").otherwise("B").alias("side"), F.element_at(ratings, (F.floor(u * 6) + 1).cast("int")).alias("rating"))

    def annotators(self) -> DataFrame:
        """``sent_id, corpus_id, annotator, label``: three annotators give every labelled document 1 to 5, some nothing."""
        labelled = self.table("labels").select("doc_id", "quality", "toxic").join(self.table("documents").select("doc_id", F.col("lang").alias("corpus_id")), "doc_id")
        names = F.explode(F.array(*map(F.lit, ("ann1", "ann2", "ann3")))).alias("annotator")
        d = labelled.select(F.col("doc_id").cast("string").alias("sent_id"), "corpus_id", "quality", names)
        u = X.uniform(F.col("annotator"), F.col("sent_id"))
        return d.select("sent_id", "corpus_id", "annotator", F.when(u < 0.95, (1 + F.floor(u * 4) + F.col("quality")).cast("int")).alias("label"))

    def attempts(self) -> DataFrame:
        """``case_id, attempt, status, event_id, ts, props``: a user's events in order as attempts."""
        from pyspark.sql import Window

        e = self.table("events")
        return e.select(F.col("user_id").alias("case_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("attempt"), F.col("event_type").alias("status"), "event_id", "ts", "value", "props")


_B = P.BLANK
_WORDS = f"list_filter(regexp_split_to_array(%s, {lit(_B + '+')}), lambda w: w <> '')"


def sql_words(t: str) -> str:
    return _WORDS % t


def sql_strip(t: str) -> str:
    return f"regexp_replace({t}, {lit(f'^{_B}+|{_B}+$')}, '', 'g')"


def sql_alpha(t: str) -> str:
    return f"coalesce(CAST(length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) AS DOUBLE) / nullif(length(regexp_replace({t}, {lit(_B)}, '', 'g')), 0), 0)"


def sql_uniform(*parts: str) -> str:
    return f"(CAST(('0x' || substr(sha256({chr(32).join(['concat_ws(' + lit(':') + ',', ', '.join(parts), ')'])}), 1, 8)) AS BIGINT) / 4294967296.0)"


def sql_q6(x: str) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) / 1e6)"


def sql_ends(t: str) -> str:
    return f"regexp_matches({sql_strip(t)}, '[.?!]\\z')"


def _sql_apply(t: str, rules) -> str:
    for pattern, new in rules:
        t = f"regexp_replace({t}, {lit(pattern)}, {lit(new)}, 'g')"
    return t


# The rules of sentence boundaries without look-around: end marks that end nothing are replaced by stand-ins, one rule after another, then the others are cut.
# Those inside quotations have a stand-in of their own for the dot: no rule brings it back.
_QUOTED = S.JOIN + S.BANG + S.WHAT
_CUT, _FREE, _ANY = S.HARD, r"(^|[^\p{L}\p{N}])", f"[{_QUOTED}]"
_STARTS = f"([ \t]+(?:{S.either(S.STARTERS)})[ \t])"
_SENTENCE_RULES = (
    (r"[\n\r\f]+", _CUT),
    (rf"({_ANY}[\"”)])[ \t]+(\p{{Lu}})", rf"\1{_CUT}\2"),
    (r"(^|[^\p{L}\p{N}.])((?:[A-Za-z]\.){1,9}[A-Za-z])\.", rf"\1\2{S.DOT}"),
    (r"(^|[^\p{L}\p{N}.])(\p{Lu})\.", rf"\1\2{S.DOT}"),
    (rf"([A-Z][.{S.DOT}][A-Z]|[ \t]I){S.DOT}{_STARTS}", r"\1.\2"),
    (rf"([AaPp][.{S.DOT}][Mm]){S.DOT}([ \t]+\p{{Lu}})", r"\1.\2"),
    (rf"{_FREE}((?i:{S.either(S.TITLES)}))\.", rf"\1\2{S.DOT}"),
    *[(rf"{_FREE}((?i:{S.either(S.SHORTENED)}))\.([ \t]+(?:[\p{{Ll}}0-9(]|I[ ']))", rf"\1\2{S.DOT}\3")] * 2,
    (rf"(^|{_CUT})([ \t]{{0,30}}\(?(?:[0-9]{{1,3}}|[A-Za-z]))\.([ \t])", rf"\1\2{S.DOT}\3"),
    (rf"([.{S.DOT}][.{S.DOT}])\.([ \t]+[^\p{{Lu}} \t])", rf"\1{S.DOT}\2"),
    (r"!([ \t]+\p{Ll})", rf"{S.BANG}\1"),
    (r"([.!?][ \t]{1,30}[0-9]{1,2})\.([ \t])", rf"\1{S.DOT}\2"),
    (rf"([.!?]+[{S.CLOSERS}]*)[ \t]+", rf"\1{_CUT}"),
)
_EDGE = rf"[ \t\n\r\f{_CUT}]"
_PIECES = ((rf"^{_EDGE}+|{_EDGE}+$", ""), (rf"[ \t\n\r\f]*{_CUT}{_EDGE}*", S.END + S.BEGIN))


def sql_sentences(t: str, repaired: bool = True) -> str:
    clean = f"translate({t}, '{S.MARKS}', '')"
    kept = f"array_to_string(list_transform(regexp_extract_all({clean}, {lit(S.STRETCH)}), lambda s: CASE WHEN regexp_matches(s, {lit(S.QUOTED)}) THEN translate(s, '.!?', '{_QUOTED}') ELSE s END), '')"
    pieces = _sql_apply(f"translate({_sql_apply(kept, _SENTENCE_RULES)}, '{_QUOTED}{S.DOT}', '.!?.')", _PIECES)
    mended = f"translate({_sql_apply(f"'{S.BEGIN}' || {pieces} || '{S.END}'", S.REPAIR if repaired else ())}, '{S.OPEN}{S.LOWER}', '{S.END}{S.BEGIN}')"
    return f"list_filter(string_split(translate(replace({mended}, '{S.END}{S.BEGIN}', '{_CUT}'), '{S.BEGIN}{S.END}', ''), '{_CUT}'), lambda s: s <> '')"


_SHELL = (
    "(w <> '' AND (w IN ({lits}) OR regexp_matches(w, {a}) OR regexp_matches(w, {b}) OR regexp_matches(w, {c}) OR regexp_matches(w, {d}) OR regexp_matches(w, '^(?:\\./|\\.\\./|~/)')"
    " OR length(w) - length(replace(w, '/', '')) >= 2 OR length(w) - length(replace(w, '\\', '')) >= 2))"
).format(lits=", ".join(map(lit, P.SHELL_LITERALS)), a=lit(P.LONG_FLAG_VALUE), b=lit(P.SHORT_FLAG), c=lit(P.ASSIGNMENT_WORD), d=lit(P.WINDOWS_PATH))

SQL_FLAGS = {
    "template_markup": "(" + " OR ".join(f"contains(t, {lit(m)})" for m in P.TEMPLATE_MARKS) + ")",
    "code_markup": f"(contains(t, '```') OR (length({sql_strip('t')}) >= 3 AND starts_with({sql_strip('t')}, '`') AND ends_with({sql_strip('t')}, '`')) OR regexp_matches(t, {lit(P.CODE_TAG)}))",
    "table_markup": f"(contains(regexp_replace(t, {lit(P.WIKI_LINK)}, '', 'g'), '|') AND (regexp_matches({sql_strip(f'regexp_replace(t, {lit(P.WIKI_LINK)}, {lit(str())}, {lit(chr(103))})')}, {lit(P.TABLE_RULE)}) OR length(regexp_replace(t, {lit(P.WIKI_LINK)}, '', 'g')) - length(replace(regexp_replace(t, {lit(P.WIKI_LINK)}, '', 'g'), '|', '')) >= 3))",
    "url": f"regexp_matches(t, {lit(P.URL)})",
    "command_path_dominated": f"(ntok > 0 AND (regexp_matches(ltrim(t), '^(?:\\$ |>>> |PS> )') OR (evidence >= 2 AND (evidence / CAST(ntok AS DOUBLE) >= 0.5 OR (led AND NOT {sql_ends('t')} AND evidence / CAST(ntok AS DOUBLE) >= 0.35)))))",
    "heading_fragment": f"regexp_matches(t, {lit(P.HEADING)})",
    "list_fragment": f"(regexp_matches(t, {lit(P.LIST_ITEM)}) AND NOT {sql_ends('t')})",
    "very_short_fragment": "ntok < 5",
    "low_alphabetic_content": "alpha < 0.6",
}

_STARTERS = ", ".join(map(lit, P.COMMAND_STARTERS))
_STRIP = lit(P.SHELL_STRIP)

VIEWS = {
    "docs": "SELECT lang AS corpus_id, CAST(doc_id AS VARCHAR) AS doc_path, text AS content FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL",
    "sentences": f"""SELECT corpus_id, doc_path, CAST(i - 1 AS INTEGER) AS sent_idx, s[i] AS sent_text, sha256(concat_ws(chr(10), corpus_id, doc_path, CAST(i - 1 AS VARCHAR), s[i])) AS sent_id
        FROM (SELECT corpus_id, doc_path, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT corpus_id, doc_path, {sql_sentences('content')} AS s FROM docs))""",
    "scores": f"SELECT *, {sql_uniform('sent_id')} AS score, {sql_uniform(lit('run2'), 'sent_id')} AS score2, {sql_uniform(lit('run3'), 'sent_id')} AS score3, {sql_q6('100 * ' + sql_alpha('sent_text'))} AS percent, NOT regexp_matches(sent_text, '\\p{{L}}') AS no_unit FROM sentences",
    "measured": f"""SELECT *, sent_text AS t, len({sql_words('sent_text')}) AS ntok, {sql_alpha('sent_text')} AS alpha, coalesce(lower(trim({sql_words('sent_text')}[1], {_STRIP})) IN ({_STARTERS}), false) AS led,
        len(list_filter(list_transform({sql_words('sent_text')}, lambda x: trim(x, {_STRIP})), lambda w: {_SHELL})) + CAST(coalesce(lower(trim({sql_words('sent_text')}[1], {_STRIP})) IN ({_STARTERS}), false) AS INTEGER) AS evidence FROM scores""",
    "strict": "SELECT *, len(reason_codes) = 0 AS keep FROM (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in SQL_FLAGS.items()) + "], lambda r: r IS NOT NULL) AS reason_codes FROM measured)",
    "pairs": "SELECT a.conv_id AS case_id, a.turn AS slot, a.text AS original, b.text AS edited, ['add_specific', 'de_specify', 'irrelevant_rewrite'][a.turn % 3 + 1] AS edit_type FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND a.text IS NOT NULL AND b.text IS NOT NULL",
    "candidates": f"SELECT case_id, slot, edit_type, metric, {sql_q6(sql_uniform('metric', 'case_id', 'slot') + ' - 0.5')} AS delta FROM (SELECT conv_id AS case_id, turn AS slot, ['add_specific', 'de_specify', 'irrelevant_rewrite'][conv_id % 3 + 1] AS edit_type, unnest(['a', 'b', 'c']) AS metric FROM conversations WHERE text IS NOT NULL)",
    "reviews": f"SELECT case_id, slot, edit_type, delta, CASE WHEN (case_id + slot) % 2 = 0 THEN 'A' ELSE 'B' END AS side, ['1', '2', '3', '4', '5', 'X'][CAST(floor({sql_uniform(lit('review'), 'case_id', 'slot')} * 6) AS INTEGER) + 1] AS rating FROM candidates WHERE metric = 'a'",
    "annotators": f"SELECT sent_id, corpus_id, annotator, CASE WHEN {sql_uniform('annotator', 'sent_id')} < 0.95 THEN CAST(1 + floor({sql_uniform('annotator', 'sent_id')} * 4) + quality AS INTEGER) END AS label FROM (SELECT CAST(l.doc_id AS VARCHAR) AS sent_id, d.lang AS corpus_id, l.quality, unnest(['ann1', 'ann2', 'ann3']) AS annotator FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
    "attempts": "SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type AS status, event_id, ts, value, props FROM events",
}


def sql(body: str, **more: str) -> str:
    """The body with the views that it names, and those that these name, before it; ``more`` are views of its own."""
    known = VIEWS | more
    needed: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b", text):
                add(known[name])
                if name not in needed:
                    needed.append(name)

    add(body)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" if needed else "") + body
