"""The stretch of a text that says most about a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from gleaner.functions import pytext
from gleaner.session import arrow_udf


def terms_of(query: Column) -> Column:
    """What ``excerpt`` looks for, as an array of texts. Their tokens are made where the excerpt is: an Arrow function inside another is not always planned."""
    return F.array(query)


def distinct_terms(texts: list[str | None]) -> list[str]:
    """The distinct tokens of two characters or more, in order; none of a null."""
    return [t for t in dict.fromkeys(t for text in texts if text is not None for t in pytext.tokens(text)) if len(t) >= 2]


def weight(terms: list[str], text: str) -> int:
    """Occurrences of the terms in the lower-cased text, each weighing its length squared."""
    low = text.lower()
    return sum(low.count(t) * len(t) ** 2 for t in terms)


def starts_of(length: int, size: int) -> list[int]:
    """Where windows of ``size`` characters begin: at a stride of half a window (120 at least), and so that the last ends with the text."""
    last = max(length - size, 0)
    return sorted({*range(0, last + 1, max(120, size // 2)), last})


def best_window(terms: list[str], text: str, size: int) -> str:
    """The earliest window of greatest weight, or the text itself if it is no longer than a window."""
    if len(text) <= size:
        return text
    low = text.lower()
    there = [t for t in terms if t in low] if len(low) == len(text) and "Σ" not in text else terms
    start = max(starts_of(len(text), size), key=lambda s: (weight(there, text[s : s + size]), -s)) if there else 0
    return text[start : start + size]


def excerpt(terms: Column, text: Column, size: int = 420) -> Column:
    """``best_window`` for a column that holds ``terms_of`` the query; texts no longer than a window don't leave the JVM."""

    def windows(terms: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or w is None else best_window(distinct_terms(w), x, size) for w, x in zip(terms, texts, strict=True)], dtype=object)

    long = F.length(text) > size
    return F.coalesce(arrow_udf(windows, StringType())(F.when(long, terms), F.when(long, text)), text)


def excerpt_weight(terms: Column, text: Column, size: int = 420) -> Column:
    """``weight`` of what ``excerpt`` gives, in one crossing."""

    def weights(terms: pd.Series, texts: pd.Series) -> pd.Series:
        rows = ((None, x) if w is None else (distinct_terms(w), x) for w, x in zip(terms, texts, strict=True))
        return pd.Series([None if x is None or own is None else weight(own, best_window(own, x, size)) for own, x in rows], dtype="Int64")

    return arrow_udf(weights, LongType())(terms, text)
