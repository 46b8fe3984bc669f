"""Sentence filters: each flag as a column, and the rules made of them.

Patterns are run only where a plain search for what they need finds it, as most sentences hold no markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.unicode import comparable, folded


def _ends(text: Column) -> Column:
    s = X.strip(text)
    return s.endswith(".") | s.endswith("?") | s.endswith("!")


def template_markup(text: Column) -> Column:
    found = F.lit(False)
    for mark in P.TEMPLATE_MARKS:
        found = found | text.contains(mark)
    return found


def inline_code(text: Column) -> Column:
    """A code fence anywhere, or a whole text in back-ticks."""
    s = X.strip(text)
    return text.contains("`") & (text.contains("```") | ((F.length(s) >= 3) & s.startswith("`") & s.endswith("`")))


def code_markup(text: Column) -> Column:
    return inline_code(text) | (text.contains("<") & text.rlike(P.CODE_TAG))


def table_markup(text: Column) -> Column:
    """A separator row or three pipes, wiki links aside."""
    rest = F.regexp_replace(text, P.WIKI_LINK, "")
    return text.contains("|") & rest.contains("|") & (X.strip(rest).rlike(P.TABLE_RULE) | (F.length(rest) - F.length(F.replace(rest, F.lit("|"), F.lit(""))) >= 3))


def url(text: Column) -> Column:
    sign = text.contains(":")
    for w in ("ww", "WW", "wW", "Ww"):
        sign = sign | text.contains(w)
    return sign & text.rlike(P.URL)


#: Each shell-like token holds one of these.
_SHELL_MARK = r"[-=/\\$>&|;]"


def shell_syntax(token: Column) -> Column:
    """Prompts, operators, flags, assignments and paths."""
    return _shell(F.btrim(token, F.lit(P.SHELL_STRIP)))


def _shell(t: Column) -> Column:
    """The same of a token without quotes and brackets around it."""
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    flag = t.startswith("-") & (t.rlike(P.LONG_FLAG_VALUE) | t.rlike(P.SHORT_FLAG))
    path = (t.contains("\\") | t.contains("/")) & (t.rlike(P.WINDOWS_PATH) | t.rlike(r"^(?:\./|\.\./|~/)") | (count("/") >= 2) | (count("\\") >= 2))
    # A word of plain letters, the usual case, is told by one pattern.
    return (t != "") & ~t.rlike(r"^\p{L}+$") & (t.isin(*P.SHELL_LITERALS) | flag | (t.contains("=") & t.rlike(P.ASSIGNMENT_WORD)) | path)


def _led(tokens: Column) -> Column:
    """Whether the first word is a command."""
    first = F.lower(F.btrim(F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit("")), F.lit(P.SHELL_STRIP)))
    return first.isin(*P.COMMAND_STARTERS)


def command_evidence(text: Column, tokens: Column | None = None) -> Column:
    """Shell-like tokens, and one more if the first word is a command."""
    tokens = X.words(text) if tokens is None else tokens
    # Trimmed once a token, and only those that can be shell-like.
    bare = F.transform(F.filter(tokens, lambda t: t.rlike(_SHELL_MARK)), lambda t: F.btrim(t, F.lit(P.SHELL_STRIP)))
    return F.when(text.rlike(_SHELL_MARK), F.size(F.filter(bare, _shell))).otherwise(0) + _led(tokens).cast("int")


def command_path_dominated(text: Column, tokens: Column | None = None, evidence: Column | None = None) -> Column:
    tokens = X.words(text) if tokens is None else tokens
    evidence = command_evidence(text, tokens) if evidence is None else evidence
    share = F.coalesce(F.try_divide(evidence, F.size(tokens)), F.lit(0.0))
    prompt = (text.contains("$ ") | text.contains("> ")) & F.ltrim(text).rlike(r"^(?:\$ |>>> |PS> )")
    return (F.size(tokens) > 0) & (prompt | ((evidence >= 2) & ((share >= 0.5) | (_led(tokens) & ~_ends(text) & (share >= 0.35)))))


def heading_fragment(text: Column) -> Column:
    return text.contains("#") & text.rlike(P.HEADING)


def list_fragment(text: Column) -> Column:
    return F.substring(text, 1, 1).isin(*"-*+0123456789 \t\n\x0b\f\r") & text.rlike(P.LIST_ITEM) & ~_ends(text)


def very_short_fragment(text: Column) -> Column:
    return X.token_count(text) < 5


def low_alphabetic_content(text: Column) -> Column:
    return X.alpha_ratio(text) < 0.6


FLAGS = {name: globals()[name] for name in P.STRICT_REASONS}


def _codes(text: Column, known: dict[str, Column] | None = None) -> Column:
    """The codes that hold, in their order, comma-joined."""
    flags = {code: (known or {}).get(code, None) for code in FLAGS}
    flags = {code: FLAGS[code](text) if flag is None else flag for code, flag in flags.items()}
    return F.concat_ws(",", *(F.when(flag, code) for code, flag in flags.items()))


def _listed(codes: Column) -> Column:
    return F.when(codes == "", F.array().cast("array<string>")).otherwise(F.split(codes, ","))


def reasons(text: Column, known: dict[str, Column] | None = None) -> Column:
    """The codes that hold, in their order; ``known``: flags that the caller has as columns already."""
    return _listed(_codes(text, known))


def strict(sentences: DataFrame, text: str = "sent_text") -> DataFrame:
    """All rows with ``reason_codes``, ``keep`` (no reason), token count, alphabetic ratio and command evidence.

    Words and ratio are columns before the flags are, so that each is made once a row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = sentences.withColumns({"__w": X.words(t), "alpha_ratio": X.alpha_ratio(t)})
    rows = rows.withColumns({"token_count": F.size("__w").cast("long"), "evidence": command_evidence(t, F.col("__w")).cast("long")})
    known = {"command_path_dominated": command_path_dominated(t, F.col("__w"), F.col("evidence")), "very_short_fragment": F.col("token_count") < 5, "low_alphabetic_content": F.col("alpha_ratio") < 0.6}
    rows = rows.withColumn("__codes", _codes(t, known))
    return rows.withColumns({"reason_codes": _listed(F.col("__codes")), "keep": F.col("__codes") == ""}).drop("__w", "__codes")


def annotatable(text: Column, least: int = 8, most: int = 40, terminal: bool = False, no_bullets: bool = False, no_code_tags: bool = False) -> Column:
    """Fit for annotation: token range, letters, no markup; options as for the sampling tools."""
    ok = (text != "") & ~template_markup(text) & ~inline_code(text) & ~table_markup(text) & X.token_count(text).between(least, most) & (X.alpha_ratio(text) >= 0.6)
    if terminal:
        ok = ok & _ends(text)
    if no_bullets:
        ok = ok & ~F.ltrim(text).startswith("- ")
    if no_code_tags:
        ok = ok & ~text.contains("<code>") & ~text.contains("</code>")
    return F.coalesce(ok, F.lit(False))


def integrity_reasons(original: Column, candidate: Column) -> Column:
    """Why a candidate is no usable edit: lines, length, no change, several sentences, new scripts, a preface."""
    s = X.strip(candidate)
    lead = folded(s)
    meta = F.lit(False)
    for prefix in P.META_PREFIXES:
        meta = meta | lead.startswith(prefix)
    tests = {
        "meta_prefix": meta,
        "multiple_sentences": F.regexp_count(s, F.lit(P.SENTENCE_END)) > 1,
        "new_non_latin_script": ~original.rlike(r"[\p{L}&&[^\x00-\x7f]]") & s.rlike(r"[\p{L}&&[^\x00-\x7f]]"),
        "not_one_nonempty_line": (s == "") | s.rlike(r"[\n\r\t]"),
        "too_long_chars": F.length(s) > 2000,
        "too_short_chars": F.length(s) < 5,
        "unchanged_normalized": comparable(s) == comparable(original),
    }
    return F.filter(F.array(*(F.when(t, code) for code, t in tests.items())), lambda r: r.isNotNull())


def gate(pairs: DataFrame, original: str = "original", edited: str = "edited", kind: str = "edit_type", limits: dict = P.GATE_LIMITS) -> DataFrame:
    """Edit gate: the pair with token ratio, content recall, marker counts and recall, and the sorted ``gate_reasons``."""
    o, e = F.col(original), F.col(edited)
    # What Python workers fold becomes columns first; all else is then made of these in generated code.
    d = pairs.withColumns({"__ow": X.edit_words(o), "__ew": X.edit_words(e), "__om": X.markers(o), "__em": X.markers(e), "__integrity": integrity_reasons(o, e)})
    d = d.withColumns({"__oc": X.content_words(F.col("__ow")), "__ec": X.content_words(F.col("__ew"))})
    ow, ew, oc, ec, om, em = (F.col(f"__{c}") for c in ("ow", "ew", "oc", "ec", "om", "em"))
    d = d.withColumns({
        "original_tokens": F.size(ow).cast("long"), "edited_tokens": F.size(ew).cast("long"), "original_content": F.size(oc).cast("long"), "edited_content": F.size(ec).cast("long"),
        "content_recall": F.size(F.array_intersect(oc, ec)) / F.greatest(F.size(oc), F.lit(1)), "original_markers": F.size(om).cast("long"), "edited_markers": F.size(em).cast("long"),
        "marker_recall": X.multiset_recall(om, em), "same_markers": om == em, "same_polarity": X.from_vocabulary(ow, P.POLARITY) == X.from_vocabulary(ew, P.POLARITY), "same_modals": X.from_vocabulary(ow, P.MODALS) == X.from_vocabulary(ew, P.MODALS),
    })
    d = d.withColumn("token_ratio", F.col("edited_tokens") / F.greatest(F.col("original_tokens"), F.lit(1)))
    k = F.col(kind)
    bound = lambda i: F.create_map(*[F.lit(v) for t, x in limits.items() for v in (t, float(x[i]))])[k]
    add, down, neutral = k == P.EDIT_TYPES[0], k == P.EDIT_TYPES[1], k == P.EDIT_TYPES[2]
    more_tokens, more_marks = F.col("edited_tokens") - F.col("original_tokens"), F.col("edited_markers") - F.col("original_markers")
    tests = {
        "concrete_marker_count_decreased": add & (more_marks < 0),
        "concrete_marker_count_increased": down & (more_marks > 0),
        "content_anchor_recall_below_min": F.col("content_recall") < bound(2),
        "insufficient_despecification_proxy": down & ~((more_tokens <= -1) | (more_marks < 0) | ((F.col("content_recall") <= 0.9) & (F.col("edited_content") <= F.col("original_content")))),
        "insufficient_specificity_addition_proxy": add & ~((more_tokens >= 2) | (more_marks >= 1)),
        "modality_changed": ~F.col("same_modals"),
        "neutral_concrete_markers_changed": neutral & ~F.col("same_markers"),
        "original_concrete_marker_lost": add & (F.col("marker_recall") < 1),
        "polarity_changed": ~F.col("same_polarity"),
        "token_ratio_above_max": F.col("token_ratio") > bound(1),
        "token_ratio_below_min": F.col("token_ratio") < bound(0),
    }
    own = F.filter(F.array(*(F.when(t, code) for code, t in tests.items())), lambda r: r.isNotNull())
    return d.withColumn("gate_reasons", F.array_sort(F.concat(own, F.col("__integrity")))).drop("same_markers", "same_polarity", "same_modals", "__integrity", *(f"__{c}" for c in ("om", "em", "ow", "ew", "oc", "ec")))
