"""Lexical features of sentences: document frequencies, tf-idf, densities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.segment import either
from ..sources.sinks import written


def document_frequency(sentences: DataFrame, text: str = "sent_text") -> DataFrame:
    """``corpus_id, token, df``: sentences of the corpus that hold the lower-cased token; counted before the shuffle."""
    return _held_by(sentences.select("corpus_id", F.array_distinct(_lowered(F.col(text))).alias("t")), "t").where("token IS NOT NULL")


def _lowered(text: Column) -> Column:
    """The lower-cased tokens, lowered in one piece: they hold no blank. A null text has none."""
    return F.array_remove(F.split(F.lower(F.array_join(X.tokens(F.coalesce(text, F.lit(""))), " ")), " "), "")


def _held_by(rows: DataFrame, tokens: str) -> DataFrame:
    """``corpus_id, token, df`` of rows with an array of distinct tokens; the null token stands for all rows of the corpus, so that one pass counts both."""
    each = F.explode(F.concat(F.col(tokens), F.array(F.lit(None).cast("string"))))
    return rows.select("corpus_id", each.alias("token")).groupBy("corpus_id", "token").agg(F.count(F.lit(1)).alias("df"))


def _weighed(counts: DataFrame) -> DataFrame:
    """``corpus_id, token, df, sentences, idf`` of written counts."""
    n = counts.where("token IS NULL").select("corpus_id", F.col("df").alias("sentences"))
    return counts.where("token IS NOT NULL").join(F.broadcast(n), "corpus_id").withColumn("idf", F.ln((1 + F.col("sentences")) / (1 + F.col("df"))) + 1)


def idf(sentences: DataFrame, text: str = "sent_text") -> DataFrame:
    """``corpus_id, token, df, idf`` with idf = ln((1 + sentences) / (1 + df)) + 1; the sentences are read once."""
    counts = written(_held_by(sentences.select("corpus_id", F.array_distinct(_lowered(F.col(text))).alias("t")), "t"), "df")
    return _weighed(counts).select("corpus_id", "token", "df", "idf")


def _terms(sentences: DataFrame, text: str, *columns: str) -> DataFrame:
    """The columns with ``n`` and ``terms``: the distinct lower-cased tokens of a sentence with their counts, made within the row by sorting it."""
    rows = sentences.select(*columns, F.sort_array(_lowered(F.col(text))).alias("t"))
    fresh = F.when(F.size("t") > 0, F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("s", fresh)
    each = F.transform("s", lambda i, k: F.struct(F.get("t", i).alias("token"), (F.coalesce(F.get("s", k + 1), F.size("t")) - i).cast("long").alias("tf")))
    return rows.select(*columns, F.size("t").alias("n"), each.alias("terms"))


def term_counts(sentences: DataFrame, text: str = "sent_text") -> DataFrame:
    """``corpus_id, sent_id, token, tf, n``: distinct lower-cased tokens of a sentence with their counts.

    Outer, as a plain explode is planned with a filter on the array, for which every step above would be done again.
    """
    return _terms(sentences, text, "corpus_id", "sent_id").select("corpus_id", "sent_id", "n", F.explode_outer("terms").alias("e")).where("e IS NOT NULL").select("corpus_id", "sent_id", "e.token", "e.tf", "n")


#: Tokens of all corpora whose idf one broadcast may hold.
TOKENS = 500_000


def tfidf(sentences: DataFrame, text: str = "sent_text", most: int = TOKENS) -> DataFrame:
    """``corpus_id, sent_id, tfidf_mean_nonzero, tfidf_max``: over the distinct tokens present; 0 without tokens.

    Terms are made and written once, with a number for each sentence, so that sums are shuffled by numbers. Of the idf table the most frequent tokens, up to ``most``,
    and all those of a thousandth of a corpus' sentences or more (few whatever the size) are broadcast: a sentence's terms are summed where they are made. Only the
    rare tokens, each in few sentences, are joined by a shuffle; so no frequent token meets in one task.
    """
    return _with_tfidf(sentences.select("corpus_id", "sent_id", text), text, most).drop(text)


def _with_tfidf(sentences: DataFrame, text: str, most: int) -> DataFrame:
    """The rows with both columns."""
    rows = written(_terms(sentences.withColumn("row", F.monotonically_increasing_id()), text, *sentences.columns, "row"), "terms")
    table = written(_weighed(written(_held_by(rows.select("corpus_id", F.col("terms.token").alias("t")), "t"), "df")), "idf")
    on = ["corpus_id", "token"]
    terms = rows.select("corpus_id", "row", "n", F.explode("terms").alias("e")).select(*on[:1], "row", "e.token", (F.col("e.tf") / F.col("n")).alias("share"))
    bits, least, room = F.floor(F.log2("df")).cast("int"), 63, most
    for power, n in sorted(table.groupBy(bits.alias("b")).count().collect(), reverse=True):  # 63 rows at most
        room -= n
        if room < 0:
            break
        least = power
    near = (bits >= least) | (F.col("df") * 1000 >= F.col("sentences"))
    frequent = table.where(near).select(*on, "idf")
    met = terms.join(F.broadcast(frequent), on)
    if room < 0:
        rare = terms.join(F.broadcast(frequent), on, "left_anti").join(table.where(~near).select(*on, "idf"), on)
        met = met.unionByName(rare)
    weights = met.select("row", (F.col("share") * F.col("idf")).alias("w"))
    stats = weights.groupBy("row").agg(F.avg("w").alias("tfidf_mean_nonzero"), F.max("w").alias("tfidf_max"))
    return rows.select(*sentences.columns, "row").join(stats, "row", "left").drop("row").na.fill(0.0, ["tfidf_mean_nonzero", "tfidf_max"])


DENSITIES = {
    "technical_token_ratio": X.is_technical,
    "identifier_density": X.is_identifier,
    "command_path_flag_density": X.is_command_path_flag,
    "version_numeric_density": X.is_version_numeric,
}
#: Commands that are plain words: other words of small letters are of no class and have no shape points.
_COMMANDS = either(w for w in re.search(r"\(\?:(.*)\|", P.COMMAND)[1].split("|") if w.isalpha())
_USUAL = rf"(?<![^ ])(?:(?!(?:{_COMMANDS})\.?(?![^ ]))[a-z]+\.?|[{re.escape(P.CORE_STRIP)}])(?: |$)"
#: A word with one capital at its start: two points, for both cases and for the change between them.
_CAPITAL = rf"^(?!(?i:{_COMMANDS})\.?$)[A-Z][a-z]+\.?$"


def densities(sentences: DataFrame, text: str = "sent_text") -> DataFrame:
    """Rows with class shares of their tokens, mean shape points, token and character counts; all 0 without tokens.

    Words in small letters and single marks, the usual case, are taken out of the joined tokens by one pattern before the others are looked at one by one.
    """
    n = F.size("__t")
    share = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
    rows = sentences.withColumn("__t", X.tokens(F.col(text)))
    rows = rows.withColumn("__rest", F.array_remove(F.split(F.regexp_replace(F.array_join("__t", " "), _USUAL, ""), " "), ""))
    rows = rows.withColumn("__odd", F.filter("__rest", lambda t: ~t.rlike(_CAPITAL)))
    out = {name: share(F.size(F.filter("__odd", test))) for name, test in DENSITIES.items()}
    out["assignment_parameter_density"] = share(F.size(F.filter("__odd", X.is_assignment)) + X.assignment_spans(F.col(text)))
    out["token_shape_complexity_mean"] = share(2 * (F.size("__rest") - F.size("__odd")) + F.aggregate("__odd", F.lit(0), lambda s, t: s + X.shape_points(t)))
    return rows.withColumns(out | {"token_count": n.cast("long"), "char_count": F.length(text).cast("long")}).drop("__t", "__rest", "__odd")


def feature_table(sentences: DataFrame, text: str = "sent_text") -> DataFrame:
    """The feature table: tf-idf and densities of every sentence, which are written with its terms, so that the sentences are read once."""
    return _with_tfidf(densities(sentences, text), text, TOKENS)
