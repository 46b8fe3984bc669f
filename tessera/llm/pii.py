"""Personal data: base patterns, and an offset-preserving reading of disguised identifiers.

A chain of transducers rewrites the text (look-alike letters, spelled digits, "at" and "dot"
disguises); each output character keeps the source range it came from. The same detectors then run on
the rewritten text, and a find that touches a rewritten character is mapped back to the source.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import keyed, map_texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost non-overlapping matches of local@domain, read outwards from each "@"."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


_ANY_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The four kinds by their patterns, in code points, ends exclusive; matches that fail a check are dropped."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _ANY_DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that look like Latin ones (source, then what they look like).
_LOOKALIKE = dict(zip("аеорсухіјѕԁԛԝһАВЕКМНОРСТХУІЈЅαοινρτυκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdqwhABEKMHOPCTXYIJSaoivptukxABEZHIKMNOPTYX", strict=True))
_POINTS = dict(zip("＠﹫．。․＿－‐‑‒–＋", "@@..._-----+", strict=True))
_UNSEEN = "​‌‍⁠﻿­"
# Digits as words in English, German, French and Spanish.
_SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_WORD = "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
#: Eight or more digits, at least one of them spelled, one after another: shorter runs are ordinary counting.
_TIMES = {"double": 2, "triple": 3}
_SPELLED_UNIT = rf"(?:(?:{'|'.join(_TIMES)})[ \t-])?(?:{_WORD}|[0-9])"
_SPELLED_RUN = re.compile(rf"(?:(?<!\w)plus[\s-]+|\+)?(?<!\w){_SPELLED_UNIT}(?:[\s,.()-]{{0,3}}(?<!\w|[0-9])?{_SPELLED_UNIT}(?!\w(?<![0-9]))){{7,}}", re.I)
_SPELLED_ONE = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.I)
_UNIT = re.compile(rf"(?:({'|'.join(_TIMES)})[ \t-])?({_WORD}|[0-9])", re.I)
#: An address as HTML entities, and one whose signs are words between one kind of joiner.
_ENTITY = re.compile(r"&(?:(#64|#x40|commat)|#46|#x2e|period);", re.I)
_JOINED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9.%+]+(([_-])at\2)[A-Za-z0-9]+(?:\2dot\2[A-Za-z0-9]+)+(?![A-Za-z0-9])", re.I)
_JOINED_DOT = re.compile(r"([_-])dot\1", re.I)
#: Signs with blanks around them: "@" with blanks on both sides, dots without or with two.
_SPACED = re.compile(r"(?<=[A-Za-z0-9])([ \t]+@[ \t]+)[A-Za-z0-9-]+(?:(?:[ \t]\.[ \t]|\.)[A-Za-z0-9-]+)*(?:[ \t]\.[ \t]|\.)[A-Za-z]{2,}(?!\w)")
_SPACED_DOT = re.compile(r"[ \t]\.[ \t]")
#: A spelled "at" before a host with plain dots is a disguise unless a word stands before it that is said of places.
_AT_HOST = re.compile(r"(?<![A-Za-z0-9._%+@-])([A-Za-z0-9._%+-]+)([ \t]+(?:at|arroba)[ \t]+)(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@]|[.-]\w)", re.I)
# Words that stand before "at" and a site's name in plain sentences.
_PLACED = frozenset(
    "a about accessible aimed all also and are arrive arrived article at available be been begin begins blog book bought buy call can check code contact data demo details directed docs documentation download downloaded "
    "email file files find findable following form found free from get go guide have here home hosted hosts in info information is it join just know learn line lines link links list listed live lives locate located log "
    "login look looked looking mail me meet more more, news not now of off offer offered on online only or order out page pages photos point pointed points posted published purchase read register released report "
    "resides run running runs save see sell served shop shopping sign site sold source start starts stay store stored support talk team that them then there this ticket tickets today up us version via video visible visit "
    "was watch we website were will with work worked working works write you".split()
)
_AT_BRACKET = re.compile(r"[ \t]?[\[({<][ \t]?(?:at|arroba|ät|@)[ \t]?[\])}>][ \t]?", re.I)
_DOT_BRACKET = re.compile(r"[ \t]?[\[({<][ \t]?(?:dot|punkt|point|punto|\.)[ \t]?[\])}>][ \t]?", re.I)
#: Without brackets "at" counts only in a whole address: name at host dot end. Each blank run is tried once, from the name's last character.
_AT_WORDS = re.compile(r"(?<=[A-Za-z0-9._%+-])([ \t]+(?:at|arroba)[ \t]+)(?!(?:the|an?|this|that|our|your|my|his|her|their)[ \t])([A-Za-z0-9-]+(?:(?:[ \t]+(?:dot|punto|punkt|point)[ \t]+|\.)[A-Za-z0-9-]+)*[ \t]+(?:dot|punto|punkt|point)[ \t]+[A-Za-z]{2,})(?!\w)", re.I)
_DOT_WORDS = re.compile(r"(?<![ \t])[ \t]+(?:dot|punto|punkt|point)[ \t]+", re.I)
_DOT_NAMES = ("dot", "punto", "punkt", "point")
_DOT_DIGITS = re.compile(r"(?<=[0-9])[ \t]+(?:dot|punto|punkt|point)[ \t]+(?=[0-9])", re.I)
_SIGNED_HOST = re.compile(r"(?:@|[\])}>])[ \t]?[A-Za-z0-9-]+(?:(?:[ \t]+(?:dot|punto|punkt|point)[ \t]+|\.)[A-Za-z0-9-]+)+", re.I)
#: What each of the patterns with a bare spelled "dot" needs.
_HAS_DOT = re.compile(r"(?:dot|punto|punkt|point)[ \t]", re.I)
#: What the patterns with a spelled "at" of their own need.
_HAS_AT = re.compile(r"[_-]at[_-]|[ \t](?:at|arroba)[ \t]+[A-Za-z0-9-]+\.[A-Za-z0-9]", re.I)
_ODD = re.compile(f"[{''.join(_LOOKALIKE)}{re.escape(''.join(_POINTS))}{_UNSEEN}０-９٠-٩۰-۹०-९Ａ-Ｚａ-ｚ]")


class Tape:
    """A text with, for each of its pieces that a transducer rewrote, the source range it stands for.

    ``cuts`` holds (start, end) here and (start, end) in the source of every rewritten piece, in order;
    between them the two differ by a constant.
    """

    def __init__(self, text: str):
        self.text, self.cuts = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) of this text by another string, for each edit; edits are in order and disjoint."""
        if not edits:
            return
        old, out, cuts, at, k, size = self.cuts, [], [], 0, 0, 0
        shift = 0
        for start, end, new in edits:
            a, b = self.source(start, end)
            out.append(self.text[at:start])
            while k < len(old) and old[k][1] <= start:
                cuts.append((old[k][0] + shift, old[k][1] + shift, *old[k][2:]))
                k += 1
            here = start + shift
            while k < len(old) and old[k][0] < end:  # a rewritten piece within is taken over
                k += 1
            cuts.append((here, here + len(new), a, b))
            out.append(new)
            shift += len(new) - (end - start)
            at = end
        cuts += [(c[0] + shift, c[1] + shift, *c[2:]) for c in old[k:]]
        out.append(self.text[at:])
        self.text, self.cuts = "".join(out), cuts

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source range of [start, end) here; a rewritten piece counts whole."""
        return self._at(start, True), self._at(end, False)

    def _at(self, place: int, left: bool) -> int:
        i = bisect.bisect_right(self.cuts, (place, float("inf"))) - 1
        if i < 0:
            return place
        a, b, c, d = self.cuts[i]
        if place >= b and not (left and a == b == place):
            return d + place - b
        return c if left or place == a else d

    def touched(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.cuts, (start,))
        return (i > 0 and self.cuts[i - 1][1] > start) or (i < len(self.cuts) and self.cuts[i][0] < end)


def _letters(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ODD.finditer(text):
        c = m[0]
        if c in _UNSEEN:
            new = ""
        elif (new := _LOOKALIKE.get(c) or _POINTS.get(c)) is None:
            new = unicodedata.normalize("NFKC", c) if c >= "＀" else str(unicodedata.digit(c))
        out.append((*m.span(), new))
    return out


def _numbers(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED_RUN.finditer(text):
        if not _SPELLED_ONE.search(m[0]):
            continue
        digits = "".join(str(_SPELLED.get(p[2].lower(), p[2])) * _TIMES.get((p[1] or "").lower(), 1) for p in _UNIT.finditer(m[0]))
        plus = "+" if m[0][:1] == "+" or m[0][:4].lower() == "plus" else ""
        if plus or not (14 <= len(digits) <= 19 and luhn(digits)):
            plus = "+" if 10 <= len(digits) <= 15 else plus
        out.append((*m.span(), plus + digits))
    return out


def _name_before(text: str, end: int, least: int) -> list[tuple[int, int]] | None:
    """The ranges of the spelled dots of the name that ends at ``end`` and begins at ``least`` or later; None if no name ends there."""
    dots, at = [], end
    while True:
        start = at
        while start > least and _LOCAL.match(text, start - 1):
            start -= 1
        if start == at or (start > 0 and (text[start - 1] == "@" or text[start - 1].isalnum() or text[start - 1] == "_")):
            return None if at == end else dots[:-1]
        word = start
        while word > least and text[word - 1] in " \t":
            word -= 1
        name = next((d for d in _DOT_NAMES if word - len(d) >= least and text[word - len(d) : word].lower() == d), None)
        if name is None or word == start:
            return dots
        at = word - len(name)
        while at > least and text[at - 1] in " \t":
            at -= 1
        if at == word - len(name):
            return dots
        dots.append((at, start))


def _signs(text: str, gated: bool = True) -> list[tuple[int, int, str]]:
    """``gated=False`` tries every pattern, also those whose fixed parts the text lacks; the edits are the same."""
    out = [(*m.span(), "@") for m in _AT_BRACKET.finditer(text)]
    out += [(*m.span(), ".") for m in _DOT_BRACKET.finditer(text)]
    if not gated or "&" in text:
        out += [(*m.span(), "@" if m[1] else ".") for m in _ENTITY.finditer(text)]
    if not gated or " @" in text or "\t@" in text:
        for m in _SPACED.finditer(text):
            out.append((*m.span(1), "@"))
            out += [(*d.span(), ".") for d in _SPACED_DOT.finditer(text, m.end(1), m.end())]
    if not gated or _HAS_AT.search(text):
        for m in _JOINED.finditer(text):
            out.append((*m.span(1), "@"))
            out += [(*d.span(), ".") for d in _JOINED_DOT.finditer(text, m.end(1), m.end())]
        out += [(*m.span(2), "@") for m in _AT_HOST.finditer(text) if m[1].lower() not in _PLACED]
    if not gated or _HAS_DOT.search(text):
        out += [(*m.span(), ".") for m in _DOT_DIGITS.finditer(text)]
        upto = 0
        for m in _AT_WORDS.finditer(text):
            dots = _name_before(text, m.start(), upto)
            if dots is None:
                continue
            upto = m.end()
            out += [(*d, ".") for d in dots]
            out.append((*m.span(1), "@"))
            out += [(*d.span(), ".") for d in _DOT_WORDS.finditer(text, *m.span(2))]
        # "name@host dot end" and bracketed "at" with bare "dot"
        for m in _SIGNED_HOST.finditer(text):
            out += [(*d.span(), ".") for d in _DOT_WORDS.finditer(text, *m.span())]
    kept, last = [], 0
    for e in sorted(set(out)):
        if e[0] >= last:
            kept.append(e)
            last = e[1]
    return kept


TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (_letters, _numbers, _signs)


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, str]]]:
    """Base spans by kind; and all spans (start, end, kind), the disguised ones that overlap no base span included."""
    text = text or ""
    base = base_spans(text)
    spans = [(a, b, k) for k in KINDS for a, b in base[k]]
    tape = Tape(text)
    for step in TRANSDUCERS:
        if step is not _letters or not text.isascii():
            tape.rewrite(step(tape.text))
    if tape.cuts:
        taken: list[tuple[int, int]] = []  # what the spans cover, in disjoint ranges
        for a, b, _ in sorted(spans):
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        for kind, found in base_spans(tape.text).items():
            for a, b in found:
                if tape.touched(a, b):
                    s, e = tape.source(a, b)
                    i = bisect.bisect_left(taken, (e,))
                    if s < e and not (i and taken[i - 1][1] > s):
                        spans.append((s, e, kind))
                        taken.insert(i, (s, e))
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become one."""
    if text is None or not spans:
        return text
    out, at, held = [], 0, 0
    for a, b, kind in sorted(spans):
        if a >= held:
            out += [text[at:a], f"<{kind}>"]
            held = at = b
        else:
            held = at = max(held, b)
    return "".join([*out, text[at:]])


def find_pii(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, ``base`` and ``spans`` (arrays of kind:start:end in source code points) and the ``redacted`` text.

    Null text counts as empty (its redacted text stays null); repeated rows each get a row; no row is dropped.
    """

    def make():
        def each(texts):
            base, spans, clean = [], [], []
            for x in texts:
                own, all_ = find(x)
                base.append([f"{k}:{a}:{b}" for a, _, k, b in sorted((a, KINDS.index(k), k, b) for k in KINDS for a, b in own[k])])
                spans.append([f"{k}:{a}:{b}" for a, b, k in all_])
                clean.append(redact(x, all_))
            return [base, spans, clean]

        return each

    strings = T.ArrayType(T.StringType())
    return map_texts(keyed(documents, key, text), [("base", strings), ("spans", strings), ("redacted", T.StringType())], make, key)
