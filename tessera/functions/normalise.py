"""Documents to plain text by format. Markdown blocks and HTML are read in Arrow batches, the rest stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup


def document_format(path: Column) -> Column:
    """markdown, rst, html or plain, by the lower-cased suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("md", "markdown"), "markdown").when(suffix == "rst", "rst").when(suffix.isin("html", "htm"), "html").otherwise("plain")


def strip_fences(text: Column) -> Column:
    """Fenced code blocks become a blank."""
    return F.regexp_replace(text, r"(?s)```.*?```", " ")


def strip_rst_code(text: Column) -> Column:
    """Code blocks up to the next line that starts in the first column, which stays."""
    kept = F.regexp_replace(text, r"(?s)\.\.\s+code-block::.*?(\n\S)", "\n$1")
    return F.regexp_replace(kept, r"(?s)\.\.\s+code-block::.*\z", " ")


def _lines(text: Column, keep) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def rst_to_text(text: Column) -> Column:
    """Without code blocks, directive lines and blank lines."""
    return _lines(strip_rst_code(text), lambda s: ~s.rlike(r"^\.\.\s+[A-Za-z0-9_]+::.*$") & (F.trim(s) != ""))


def markdown_to_text(text: Column) -> Column:
    """Without front matter, fences, code, raw HTML and link definitions: the inline text of headings, items and paragraphs as written, one block after another."""
    return markup.markdown(strip_fences(F.regexp_replace(text, r"(?s)^---\s*\n.*?\n---\s*\n", "")))


def html_to_text(html: Column, bare: bool = True) -> Column:
    """Text outside pre, script, style and nav, its pieces stripped and joined by a blank; ``bare`` as in ``markup.html_strings``."""
    return markup.html(html, bare)


def to_text(path: Column, content: Column) -> Column:
    kind = document_format(path)
    only = lambda k: F.when(kind == k, content)  # noqa: E731  the readers get a null for texts of another format
    return F.when(kind == "markdown", markdown_to_text(only("markdown"))).when(kind == "rst", rst_to_text(content)).when(kind == "html", html_to_text(only("html"))).otherwise(content)
