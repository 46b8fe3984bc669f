"""Markdown blocks and HTML to plain text; neither grammar is regular, so both are Arrow-batched functions.

Markdown follows the block structure of CommonMark: what is kept is the inline text of paragraphs and
headings, as written, wherever containers put them; code, raw HTML, rules and link definitions go.
"""

from __future__ import annotations

import re
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-_*])[ \t]*(?:\1[ \t]*){2,}$")
_QUOTES = re.compile(r"(?: {0,3}> ?)+")
_ITEM = re.compile(r"( {0,3})([-+*]|([0-9]{1,9})[.)])(?=[ \t]|$)([ \t]*)")
_DEFINITION = re.compile(
    r"""[ ]{0,3}\[(?=[^\]]*[^\s\]])(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)"""
)
# The kinds of raw HTML blocks (what opens one, what closes it) and the names of block elements.
_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th "
    "thead title tr track ul"
).replace(" ", "|")
_ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_RAW = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_NAMES})(?:\s|/?>|$)", re.I), None),
]
_ALONE = re.compile(rf" {{0,3}}(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _item(line: str, inside: bool) -> tuple[int, str] | None:
    """(column of its content, rest of the line) if the line opens a list item; ``inside`` a paragraph not every one may."""
    m = _ITEM.match(line)
    if not m or _RULE.match(line):
        return None
    rest, gap = line[m.end() :], len(m[4])
    if inside and (not rest or (m[3] is not None and int(m[3]) != 1)):
        return None
    start = len(m[1]) + len(m[2])
    if not rest:
        return start + 1, ""
    return (start + gap, rest) if gap < 5 else (start + 1, " " * (gap - 1) + rest)


def _quotes(line: str, most: int) -> tuple[int, str]:
    """How many marks of quotations a line begins with, up to ``most``, and what is left of it: all at once, however deep they go."""
    m = _QUOTES.match(line)
    n, at = (m[0].count(">"), m.end()) if m else (0, 0)
    if n > most:
        n, at = most, 0
        for _ in range(most):
            at = line.index(">", at) + 1
        at += line[at : at + 1] == " " and most > 0
    return n, line[at:]


class Blocks:
    """Reads lines one after another, in time in proportion; the inline texts of paragraphs and headings come in ``out``.

    ``open`` holds the quotations (0) and list items (the column of their content) around the current line, ``empty``
    whether an item has no content yet; ``text`` is the paragraph being read; ``verbatim`` holds the pattern of the line that ends a
    block that is dropped, None standing for a blank line.
    """

    def __init__(self):
        self.out: list[str] = []
        self.open: list[int] = []
        self.empty: list[bool] = []
        self.text: list[str] = []
        self.verbatim: tuple[re.Pattern | None] | None = None

    def close(self, upto: int | None = None) -> bool:
        """End the paragraph, and containers from ``upto`` on; False if nothing of it but link definitions was there."""
        body, at = "\n".join(self.text), 0
        while m := _DEFINITION.match(body, at):
            at = m.end()
        body = body[at:].strip()
        self.text, self.verbatim = [], None
        if upto is not None:
            del self.open[upto:], self.empty[upto:]
        if body:
            self.out.append(body)
        return bool(body)

    def enter(self, column: int, empty: bool) -> None:
        self.open.append(column)
        self.empty.append(empty)

    def line(self, line: str) -> None:
        matched, rest = self._within(line)
        whole = matched == len(self.open)
        if self.verbatim and whole:
            end = self.verbatim[0]
            if end.search(rest) if end else not rest.strip():
                self.verbatim = None
            return
        if self.verbatim:
            self.close(matched)
            whole = True
        if not rest.strip():
            self.close(matched)
            return
        if whole and self.text and _indent(rest) < 4 and _SETEXT.match(rest):
            if not self.close():
                self.text.append(rest)
            return
        while _indent(rest) < 4:
            n, rest = _quotes(rest, len(rest))
            if n:
                self.close(matched)
                for _ in range(n):
                    self.enter(0, False)
                matched, whole = len(self.open), True
                continue
            if found := _item(rest, whole and bool(self.text)):
                column, rest = found
            else:
                break
            self.close(matched)
            self.enter(column, not rest.strip())
            matched, whole = len(self.open), True
        self._leaf(rest, matched, whole)

    def _within(self, line: str) -> tuple[int, str]:
        """How many of the open containers the line belongs to, and what is left of it inside them."""
        i, blank = 0, not line.strip()
        while i < len(self.open):
            column = self.open[i]
            if column == 0:
                last = next((j for j in range(i, len(self.open)) if self.open[j]), len(self.open))
                n, line = _quotes(line, last - i)
                i += n
                if i < last:
                    return i, line
                blank = not line.strip()
                continue
            if blank:
                if self.empty[i]:
                    return i, line
            elif _indent(line) >= column:
                line, self.empty[i] = line[column:], False
            else:
                return i, line
            i += 1
        return len(self.open), line

    def _leaf(self, rest: str, matched: int, whole: bool) -> None:
        if not rest.strip():
            return
        if _indent(rest) > 3:
            if self.text:
                self.text.append(rest)
            else:
                self.close(matched)  # indented code
            return
        if m := _FENCE.match(rest):
            self.close(matched)
            self.verbatim = (re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$"),)
        elif m := _ATX.match(rest):
            self.close(matched)
            self.out.append((m[1] or "").strip())
        elif _RULE.match(rest):
            self.close(matched)
        elif raw := next(((end,) for begin, end in _RAW if begin.match(rest)), (None,) if not self.text and _ALONE.match(rest) else None):
            self.close(matched)
            if raw[0] is None or not raw[0].search(rest):
                self.verbatim = raw
        elif self.text:  # a paragraph goes on, also where a container's marks are missing
            self.text.append(rest)
        else:
            if not whole:
                self.close(matched)
            self.text.append(rest)


def markdown_blocks(text: str | None) -> str | None:
    """The inline texts, one block after another; null stays null."""
    if text is None:
        return None
    blocks = Blocks()
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        blocks.line(_untab(line) if "\t" in line else line)
    blocks.close()
    return "\n".join(b for b in blocks.out if b.strip())


def _untab(line: str) -> str:
    """Tabs among the blanks at the beginning, and behind the mark of a list item or quotation, as blanks up to the next fourth column."""
    lead = re.match(r"[ \t]*(?:(?:[-+*>]|[0-9]{1,9}[.)])[ \t]*)*", line).end()
    return line[:lead].expandtabs(4) + line[lead:]


class _Strings(HTMLParser):
    """Text between tags, outside elements that hold no prose."""

    SKIPPED = ("pre", "script", "style", "nav")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.skipped = [], [], []

    def _cut(self) -> None:
        piece = "".join(self.held).strip()
        self.held.clear()
        if piece:
            self.out.append(piece)

    def handle_starttag(self, tag, attrs):
        self._cut()
        if tag in self.SKIPPED:
            self.skipped.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._cut()

    def handle_endtag(self, tag):
        self._cut()
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skipped:
            self.held.append(data)

    def handle_comment(self, data):
        self._cut()

    handle_decl = handle_pi = unknown_decl = handle_comment


_REFERENCE = re.compile(r"&([A-Za-z][A-Za-z0-9]*+)(;?)")


def _literal(m: re.Match) -> str:
    return m[0] if m[2] and m[1] + ";" in html5 else "&amp;" + m[0][1:]


def html_strings(html: str | None, bare: bool = True) -> str | None:
    """The text pieces between tags, stripped and joined by a blank; null stays null.

    ``bare``: entities' names without a semicolon count as HTML 5 has them; else such a name stays as written.
    """
    if html is None:
        return None
    reader = _Strings()
    reader.feed(html if bare else _REFERENCE.sub(_literal, html))
    reader.close()
    reader._cut()
    return " ".join(reader.out)


def _each(function):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def markdown(text: Column) -> Column:
    return F.pandas_udf(_each(markdown_blocks), "string")(text)


def html(text: Column, bare: bool = True) -> Column:
    return F.pandas_udf(_each(partial(html_strings, bare=bare)), "string")(text)
