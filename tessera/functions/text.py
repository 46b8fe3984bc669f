"""Scalar string functions on columns; built-in expressions only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import unicode


def trimmed(text: Column, marks: str) -> Column:
    """Without the marks at both ends; only a text that has one there is copied, as that goes character by character."""
    at_ends = F.lit(False)
    for mark in marks:
        at_ends = at_ends | text.startswith(mark) | text.endswith(mark)
    return F.when(at_ends, F.btrim(text, F.lit(marks))).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return trimmed(text, P.BLANKS)


def words(text: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    inner = strip(text)
    # Single spaces alone, the usual case, need no pattern.
    mixed = F.lit(False)
    for blank in ("  ", *P.BLANKS.replace(" ", "")):
        mixed = mixed | text.contains(blank)
    return F.when(inner == "", F.array().cast("array<string>")).when(mixed, F.split(inner, rf"{P.BLANK}+")).otherwise(F.split(inner, " "))


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def alpha_ratio(text: Column) -> Column:
    """Letters over characters that are no white space; 0 where there are none."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    rest = text
    for blank in P.BLANKS:
        rest = F.replace(rest, F.lit(blank), F.lit(""))
    rest = F.length(rest)
    return F.coalesce(F.try_divide(letters, rest), F.lit(0.0))


def tokens(text: Column) -> Column:
    """Tokens of the features: paths, flags, assignments, word-like runs and single marks."""
    return F.regexp_extract_all(text, F.lit(P.TOKEN), F.lit(0))


def core(token: Column, marks: str = P.CORE_STRIP) -> Column:
    """The token without a set of marks at both ends."""
    return F.btrim(token, F.lit(marks))


def _any(value: Column, *patterns: str) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | value.rlike(p)
    return (value != "") & found


def is_technical(token: Column) -> Column:
    return _any(core(token, P.TECH_STRIP), P.FLAG, P.PATH, P.VERSION, P.SNAKE, P.CAMEL, P.DOTTED)


def _named(token: Column) -> Column:
    return F.btrim(core(token), F.lit(":"))


def is_identifier(token: Column) -> Column:
    return _any(_named(token), P.SNAKE, P.CAMEL, P.DOTTED, P.ACRONYM)


def is_command_path_flag(token: Column) -> Column:
    return _any(_named(token), P.FLAG, P.PATH, P.COMMAND)


def is_version_numeric(token: Column) -> Column:
    return _any(_named(token), P.VERSION, P.NUMERIC)


def is_assignment(token: Column) -> Column:
    c = core(token)
    return _any(c, P.ASSIGNMENT, P.YAML_KEY) | (c.contains("=") & F.substring_index(c, "=", 1).rlike(P.FLAG))


def assignment_spans(text: Column) -> Column:
    """Key-value and flag-value spans of the sentence; each holds the mark that is looked for first."""
    found = lambda mark, p: F.when(text.contains(mark), F.regexp_count(text, F.lit(p))).otherwise(0)
    return found(":", P.YAML_SPAN) + found("-", P.FLAG_SPAN)


def shape_points(token: Column) -> Column:
    """0 to 5: both cases, a digit, a separator, any other mark, a change of case between neighbours."""
    c = core(token)
    points = [c.rlike(r"\p{Ll}") & c.rlike(r"\p{Lu}"), c.rlike(r"\p{Nd}"), c.rlike(r"[_.:/-]"), c.rlike(r"[^\p{L}\p{N}_.:/-]"), c.rlike("[a-z][A-Z]|[A-Z][a-z]")]
    return sum((p.cast("int") for p in points[1:]), points[0].cast("int"))


def sentence_id(corpus: Column, path: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", corpus, path, index.cast("string"), text), 256)


def namespaced_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a null character."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def seed31(*parts: Column) -> Column:
    """The first four digest bytes of the parts joined by colons, without the top bit."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the digest of the parts joined by colons; the same in every run."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def slug(title: Column, most: int = 160) -> Column:
    """A safe file name: runs of other characters become one underscore; ``untitled`` if nothing is left."""
    safe = F.substring(F.btrim(F.regexp_replace(title, r"[^A-Za-z0-9._-]+", "_"), F.lit("._")), 1, most)
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("untitled"))


def edit_words(text: Column) -> Column:
    """Word tokens of the edit gates: letters, digits and underscores with inner - . / or :, after NFKC, case folded."""
    return unicode.words(text, P.WORD)


def content_words(words: Column) -> Column:
    """The different words that carry content, of those that ``edit_words`` gave."""
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*P.STOP_WORDS)))


def markers(text: Column) -> Column:
    """Concrete markers with repeats, sorted and case folded: URLs, paths, flags, numbers, snake and camel names, quoted code."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (P.MARKER_URL, P.MARKER_PATH, P.MARKER_FLAG, P.MARKER_NUMBER, P.MARKER_SNAKE, P.MARKER_CAMEL)]
    quoted = F.transform(F.regexp_extract_all(text, F.lit(P.MARKER_CODE), F.lit(1)), lambda m: F.regexp_replace(m, r"^[\s\x1C-\x1F\x85\p{Z}]+|[\s\x1C-\x1F\x85\p{Z}]+$", ""))
    trimmed = F.transform(unicode.casefold_parts(text, F.flatten(F.array(*found))), lambda m: F.rtrim(m, F.lit(P.MARKER_TAIL)))
    return F.array_sort(F.filter(F.concat(trimmed, unicode.casefold_parts(text, quoted)), lambda m: m != ""))


def multiset_recall(before: Column, after: Column) -> Column:
    """The share of ``before`` that ``after`` still holds, counted with repeats; 1 if there is nothing to hold."""
    kept = F.aggregate(F.array_distinct(before), F.lit(0), lambda n, m: n + F.least(F.size(F.filter(before, lambda x: x == m)), F.size(F.filter(after, lambda x: x == m))))
    return F.when(F.size(before) == 0, F.lit(1.0)).otherwise(kept / F.size(before))


def from_vocabulary(words: Column, vocabulary: tuple[str, ...]) -> Column:
    """The sorted multiset of the words that are in a vocabulary."""
    return F.array_sort(F.filter(words, lambda w: w.isin(*vocabulary)))


def similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)
