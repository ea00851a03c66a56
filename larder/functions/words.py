"""Folding of text to plain words: entities decoded, case folded, NFKD without marks, runs of a-z and 0-9.

No Spark built-in decodes HTML entities or applies NFKD, so these are Arrow-batched functions. Plain
ASCII text without an entity takes a path of two string operations.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

WORD = re.compile(r"[a-z0-9]+")
_marks: re.Pattern | None = None


def marks() -> re.Pattern:
    """A pattern of every character with a combining class, built once per process."""
    global _marks
    if _marks is None:
        points = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
        runs, start = [], points[0]
        for a, b in zip(points, points[1:] + [None]):
            if b != a + 1:
                runs.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
                start = b
        _marks = re.compile(f"[{''.join(runs)}]+")
    return _marks


def unescape(text: str, rounds: int = 4) -> str:
    """HTML entities decoded until nothing changes, ``rounds`` times at most."""
    for _ in range(rounds):
        if "&" not in text:
            break
        decoded = html.unescape(text)
        if decoded == text:
            break
        text = decoded
    return text


def fold(text: str | None) -> str:
    """Case-folded text in NFKD without combining marks; null gives the empty string."""
    if not text:
        return ""
    text = unescape(text)
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFKD", text.casefold())
    return folded if folded.isascii() else marks().sub("", folded)


def split_words(text: str | None) -> list[str]:
    return WORD.findall(fold(text))


@pandas_udf(ArrayType(StringType()))
def _words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(split_words, na_action=None)


@pandas_udf(StringType())
def _folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(fold, na_action=None)


def words(column: Column) -> Column:
    """The words of a text in order, repeats kept; null, empty and wordless texts give an empty list."""
    return _words(column)


def folded(column: Column) -> Column:
    """The folded text as one string; null gives the empty string."""
    return _folded(column)
