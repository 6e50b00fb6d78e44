"""Word, space and line classes, case folding, normalization and tokens.

Java and Python disagree on what a "word" or a "space" is beyond ASCII, so the
classes are spelled out here and used by every pattern in the library.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Use inside brackets, in a pattern that starts with (?U).
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029]"
_ASCII = r"^\p{ASCII}*$"


def unicode_pattern(pattern: str) -> str:
    """Give ``\\b``, ``\\w``, ``\\s`` and ``.`` of a pattern one Unicode meaning."""
    out = pattern.replace(r"\b", BOUNDARY).replace(r"\w", f"[{WORD}]").replace(r"\s", f"[{SPACE}]")
    return "(?dU)" + out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda items: None if items is None else [
        None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in items])


@F.pandas_udf(T.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def is_ascii(text: Column) -> Column:
    return text.rlike(_ASCII)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def casefold(text: Column) -> Column:
    """Full case folding. Only rows with non-ASCII text carry data to Python."""
    return F.coalesce(_casefold(F.when(~is_ascii(text), text)), F.lower(text))


def normalize_texts(texts: Column) -> Column:
    """Normalize each text of an array: compatibility form, folded case, no
    invisible format characters, no block comments, single spaces.

    The compatibility form has no built-in expression, so rows with a non-ASCII
    text go through one Arrow batch function; the rest stays in the JVM.
    """
    foreign = F.exists(texts, lambda t: ~is_ascii(t))
    folded = F.coalesce(_fold_all(F.when(foreign, texts)), F.transform(texts, F.lower))

    def tidy(text: Column) -> Column:
        text = F.regexp_replace(text, r"\p{Cf}", "")
        text = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
        text = F.regexp_replace(text, rf"(?U)[{SPACE}]+", " ")
        return F.regexp_replace(text, r"^ | $", "")

    return F.transform(folded, tidy)


def word_tokens(text: Column) -> Column:
    """Distinct words of the folded text, sorted; no text gives no words."""
    words = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(rf"[{WORD}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(words))


def first_line(text: Column) -> Column:
    return F.split(text, LINE_BREAK, 2).getItem(0)
