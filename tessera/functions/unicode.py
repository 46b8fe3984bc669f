"""Unicode normalisation for comparison; Spark has none, so this is an Arrow-batched function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


ASCII = r"^\p{ASCII}*$"


def _comparable(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold(), na_action="ignore")


def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def _words(texts: pd.Series) -> pd.Series:
    word = re.compile(r"\w+(?:[-./:]\w+)*")
    return texts.map(lambda t: [w.casefold() for w in word.findall(unicodedata.normalize("NFKC", t))], na_action="ignore")


def _casefold(lists: pd.Series) -> pd.Series:
    return lists.map(lambda row: [t.casefold() for t in row], na_action="ignore")


def _beyond_ascii(text: Column, plain: Column, function, kind: str, value: Column) -> Column:
    """``plain`` where the text is ASCII; elsewhere the function, which gets a null for the rows that don't need it."""
    easy = text.rlike(ASCII)
    return F.when(easy, plain).otherwise(F.pandas_udf(function, kind)(F.when(~easy, value)))


def comparable(text: Column) -> Column:
    """NFKC, stripped, white space collapsed, case folded. ASCII texts never leave the JVM."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B\x1c-\x1f]+", " ")))
    return _beyond_ascii(text, plain, _comparable, "string", text)


def folded(text: Column) -> Column:
    """NFKC and case folded, white space as it is."""
    return _beyond_ascii(text, F.lower(text), _folded, "string", text)


def words(text: Column, pattern: str) -> Column:
    """Runs of word characters with inner - . / or :, found after NFKC and then case folded; ``pattern`` says the same of ASCII texts."""
    return _beyond_ascii(text, F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), _words, "array<string>", text)


def casefold_parts(text: Column, parts: Column) -> Column:
    """The parts of a text, an array, case folded."""
    return _beyond_ascii(text, F.transform(parts, F.lower), _casefold, "array<string>", parts)
