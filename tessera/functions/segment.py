"""Sentence boundaries by rules, in time linear in a text's length, all in generated code.

Every end mark before a blank is a likely boundary and gets a mark that no text holds (a noncharacter of Unicode); one
pass then takes back those that an abbreviation, an initial, a number or what follows speaks against, looking
around the marks only. A line's end always is a boundary.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# Stand-ins for . ! and ? inside quotations; a likely and a sure boundary; begin and end of a piece; a piece that joins the one before; a short piece that may take the next; a piece in lower case.
DOT, BANG, WHAT, SOFT, HARD, BEGIN, END, JOIN, OPEN, LOWER = map(chr, range(0xFDD0, 0xFDDA))
MARKS = DOT + BANG + WHAT + SOFT + HARD + BEGIN + END + JOIN + OPEN + LOWER


def either(words: Iterable[str]) -> str:
    """A pattern for any of the words, with common beginnings told once."""
    tails: dict[str, set[str]] = {}
    words = set(words)
    for w in words - {""}:
        tails.setdefault(w[0], set()).add(w[1:])
    parts = [re.escape(head) + either(rest) for head, rest in sorted(tails.items())]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?" if "" in words else "") if len(parts) > 1 or "" in words else parts[0]


# Forms of address, offices and ranks, in the usual short forms of style guides: a name follows.
_ADDRESS = "mr mrs ms mx messrs mmes dr prof st hon rev fr sr"
_OFFICES = "pres gov sen rep atty supt insp"
_RANKS = "gen lt col maj capt cmdr adm brig sgt cpl"
#: Before a name: the dot never ends a sentence. So it is before what a mountain, a figure or an opponent is called.
TITLES = f"{_ADDRESS} {_OFFICES} {_RANKS} mt mts fig figs vs viz".split()
#: Their dot ends a sentence only before a capital.
SHORTENED = (
    "abbr acad al alt amp app appt approx apr arch art assn assoc asst attn aug ave avg bldg blvd bros cal calc cap cc cert cf ch chap cit co conf config "
    "cont corp ct ctr dec def deg dep dept dest dev diff dist div doc ed eds edn eg encl env eq eqs esp esq est etc ex exc excl expt ext feb fl fn "
    "fri ft gal gb ghz govt hr hrs hwy hz ibid ie illus inc incl info init inst intl intro jan jr jul jun kb kg km lb lbs lib ltd max mb med mfg mfr mgr mhz "
    "mi min mins misc mkt mo mon mtg nat natl neg nov no nos obj oct op opp orig oz p par para pct pg pl pls pos pp prev prob proc prod pt pub pvt qty rd ref refs reg "
    "resp rev rm sat sec secs sect sep sept seq ser sic sing spec sq std sub subj sun supp syn tech tel temp thu thurs trans tue tues tx univ vol vols wed wk wks yr yrs"
).split()
#: Closed classes of words that begin a sentence more often than they follow initials such as those of a country: articles, pronouns, pointing and asking words, links.
STARTERS = [w.capitalize() for w in "a an the i you he she it we they this that these those here there who what when where why which how but and so yet if as after before since although while then".split()]

_BLANK = r"[ \t]"
_FREE = r"(?:^|[^\p{L}\p{N}])"
#: Marks that close what a sentence ends in. Looking back has to end somewhere: behind more than 8 of these, for more than 10 initials in a row, or a list's
#: number more than 30 blanks into its line, no exception is made, and the mark is a boundary.
CLOSERS = "\"'”’)\\]"
_SHUT = f"[{CLOSERS}]{{0,8}}{SOFT}"
_STARTS = rf"{_BLANK}+(?:{either(STARTERS)}){_BLANK}"
#: A likely boundary behind a word that is longer than any abbreviation needs no look at its word.
_LONG = max(map(len, TITLES)) + 1
#: What a likely boundary is no boundary before, and after; what is cheap to see comes first.
NO_BOUNDARY = "|".join((
    rf"(?={_BLANK}+[^\p{{Lu}} \t])(?:"
    + "|".join((
        rf"(?<={_FREE}(?i:{either(SHORTENED)})\.{SOFT})(?={_BLANK}+[\p{{Ll}}0-9(])",
        # Dots that leave a thought open, and shouts inside a sentence.
        rf"(?<=\.\.\.{SOFT})",
        rf"(?<=!{SOFT})(?={_BLANK}+\p{{Ll}})",
    ))
    + ")",
    rf"(?={_BLANK}+I[ '])(?<={_FREE}(?i:{either(SHORTENED)})\.{SOFT})",
    rf"(?<![\p{{L}}\p{{N}}]{{{_LONG}}}\.{SOFT})(?:"
    + "|".join((
        rf"(?<={_FREE}(?i:{either(TITLES)})\.{_SHUT})",
        # Initials, one or several, unless the next sentence plainly begins: after those of a country, after I, after a.m. and p.m.
        rf"(?<=[A-Za-z\p{{Lu}}]\.{_SHUT})(?<=(?:^|[^\p{{L}}\p{{N}}.])(?:\p{{Lu}}|(?:[A-Za-z]\.){{1,9}}[A-Za-z])\.{_SHUT})(?!(?<=(?:[A-Z]\.[A-Z]|{_BLANK}I)\.{SOFT}){_STARTS}|(?<=[AaPp]\.[Mm]\.{SOFT}){_BLANK}+\p{{Lu}})",
        # The number or letter of a list item, at the start of a line.
        rf"(?<=[^\p{{L}}\p{{N}}][A-Za-z]\.{SOFT}|^[A-Za-z]\.{SOFT}|[0-9]\.{SOFT})(?<=(?:^|{HARD}){_BLANK}{{0,30}}\(?(?:[0-9]{{1,3}}|[A-Za-z])\.{SOFT})",
    ))
    + ")",
))
#: The number of a list item behind a sentence.
NO_ITEM = rf"(?<=[.!?]{SOFT}{_BLANK}{{1,30}}[0-9]{{1,2}}\.{SOFT})"
#: Stretches of a text: bracketed and quoted ones, what lies between them, and marks that have no partner.
STRETCH = rf"\([^()\n\r\f]+\)|\"[^\"\n\r\f]+\"|“[^“”\n\r\f]+”|[^(\"“]+|[(\"“]"
QUOTED = r"^(?:\(.+\)|\".+\"|“.+”)$"

#: The repair of fragments, on pieces between BEGIN and END.
REPAIR = (
    # A lone mark, or up to three characters that end in a colon, joins the piece before.
    (rf"{BEGIN}([):;,–—-]|[^{BEGIN}{END}]{{0,2}}:){END}", rf"{JOIN}\1{END}"),
    (rf"^{JOIN}", BEGIN),
    (END + JOIN, " "),
    # A piece of up to three characters takes the next one if that starts in lower case, two at a time.
    (rf"{BEGIN}([^{BEGIN}{END}]{{1,3}}){END}", rf"{BEGIN}\1{OPEN}"),
    (rf"{BEGIN}(\p{{Ll}})", rf"{LOWER}\1"),
    (rf"{OPEN}{LOWER}([^{BEGIN}{END}{OPEN}{LOWER}]*)[{END}{OPEN}]", rf" \1{END}"),
)


def _apply(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", new))
    return text


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once though the body names it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A piece that joins the one before.
JOINS = r"^(?:[):;,–—-]|[\s\S]{0,2}:)\z"
#: No character takes more bytes.
_WIDE = 4


def sentences(text: Column, repaired: bool = True) -> Column:
    """The sentences of a text, in order and stripped; a line's end always ends one. ``repaired=False`` leaves fragments alone."""
    # All marks begin with the same two bytes, which few texts hold.
    marked = F.contains(text.cast("binary"), F.lit(MARKS[0].encode()[:2])) & text.rlike(f"[{MARKS[0]}-{MARKS[-1]}]")
    clean = F.when(marked, F.translate(text, MARKS, "")).otherwise(text)
    whole = _let(clean, lambda c: _let(c.contains("(") | c.contains('"') | c.contains("“"), lambda quoted: _bounded(c, quoted)))

    def pieces(cut: Column) -> Column:
        behind = f"[{SOFT}{HARD}][ \t{SOFT}{HARD}]*"
        # A likely boundary has no blank before it, so only line ends can.
        each = F.when(cut.contains(" " + HARD) | cut.contains("\t" + HARD), F.split(cut, f"{_BLANK}*{behind}")).otherwise(F.split(cut, behind))
        each = F.when(cut == "", F.array().cast("array<string>")).otherwise(each)
        return _let(each, lambda e: F.when(fragments(e), repair(e)).otherwise(e)) if repaired else each

    return _let(_let(whole, lambda w: trimmed(w, f" \t{SOFT}{HARD}")), pieces)


def fragments(pieces: Column) -> Column:
    """Whether the repair changes any of the pieces: one joins the one before, or a short one has one in lower case behind it."""
    joins = lambda p, i: (i > 0) & p.rlike(JOINS)
    takes = lambda p, i: (F.length(p) <= 3) & F.coalesce(F.get(pieces, i + 1).rlike(r"^\p{Ll}"), F.lit(False))
    return F.size(F.filter(pieces, lambda p, i: (F.octet_length(p) <= 3 * _WIDE) & (joins(p, i) | takes(p, i)))) > 0


def _bounded(clean: Column, quoted: Column) -> Column:
    """A text with a mark at each boundary."""
    inside = lambda s: F.when(s.rlike(QUOTED), F.translate(s, ".!?", DOT + BANG + WHAT)).otherwise(s)
    kept = F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(STRETCH), F.lit(0)), inside), "")
    # Behind a quotation that ended inside, another sentence begins with a capital.
    kept = F.regexp_replace(kept, rf"([{DOT}{BANG}{WHAT}][\"”)])(?={_BLANK}+\p{{Lu}})", f"$1{HARD}")
    cut = F.regexp_replace(F.when(quoted, kept).otherwise(clean), rf"[.!?][{CLOSERS}]*(?={_BLANK})", f"$0{SOFT}")
    cut = F.when(clean.contains("\r") | clean.contains("\f"), F.translate(cut, "\n\r\f", HARD * 3)).otherwise(F.replace(cut, F.lit("\n"), F.lit(HARD)))
    cut = F.regexp_replace(F.regexp_replace(cut, f"{SOFT}(?:{NO_BOUNDARY})", ""), f"{SOFT}{NO_ITEM}", "")
    return F.when(quoted, F.translate(cut, DOT + BANG + WHAT, ".!?")).otherwise(cut)


def repair(pieces: Column) -> Column:
    """An array of pieces with its fragments joined; without a piece of up to three characters there are none."""
    marked = _apply(F.concat(F.lit(BEGIN), F.array_join(pieces, END + BEGIN), F.lit(END)), REPAIR)
    mended = F.split(F.btrim(marked, F.lit(BEGIN + LOWER + END + OPEN)), f"[{END}{OPEN}][{BEGIN}{LOWER}]")
    return F.when(F.size(pieces) > 0, mended).otherwise(pieces)
