"""Penn Treebank tokenisation as a chain of replacements, all in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# The published rules, in their order: opening quotes, punctuation, brackets, closing quotes, contractions.
RULES = (
    (r'^"', "`` "), (r"(``)", " $1 "), (r'([ (\[{<])("|\'{2})', "$1 `` "),
    (r"([:,])([^\d])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "), (r"([;@#$%&])", " $1 "),
    (r"([^\.])(\.)([\]\)}>\"']*)\s*$", "$1 $2$3 "), (r"([?!])", " $1 "), (r"([^'])' ", "$1 ' "),
    (r"([\]\[\(\)\{\}\<\>])", " $1 "), (r"--", " -- "), (r'"', " '' "), (r"(\S)('')", "$1 $2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", " $1 $2 "), (r"(?i)\b(gon|wan)(na)\b", " $1 $2 "), (r"(?i)\b(got)(ta)\b", " $1 $2 "), (r"(?i)\b(gim|lem)(me)\b", " $1 $2 "),
)


def treebank(text: Column) -> Column:
    """Tokens of one sentence."""
    t = text
    for i, (pattern, new) in enumerate(RULES):
        t = F.regexp_replace(t, pattern, new)
        if i == 11:
            t = F.concat(F.lit(" "), t, F.lit(" "))
    return words(t)
